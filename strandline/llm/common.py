"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from strandline.sources.folders import checkpointed, shared_folder, spread  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def hash_fraction(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes or one row, so that very long texts don't add up."""
    for batch in batches:
        step = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    # Workers are used again by other stages: give back what the batches took.
    pa.default_memory_pool().release_unused()


def widened(schema: StructType, *more: tuple[str, str]) -> StructType:
    """A copy of a schema with more columns."""
    wide = StructType(list(schema.fields))
    for name, kind in more:
        wide = wide.add(name, DataType.fromDDL(kind))
    return wide


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column of that name (in any case) is there."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
