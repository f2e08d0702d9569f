"""Stored records read back: header, body, and whether the content still derives its recorded digest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.contracts import LANES, is_scope, is_token, is_world
from strandline.functions.identity import DEFAULT, Formats, episode_id, payload_digest

# Header keys that must stand once, section marks, and how many readings of a body are tried.
REQUIRED = ("episode_id", "world", "scope", "lane", "harness", "session_id", "turn_id", "event_time_ms", "capture_time_ms", "capture_policy", "turn_outcome", "payload_digest")
USER, ASSISTANT, TOOLS, MAX_READINGS = "\n## User\n\n", "\n\n## Assistant\n\n", "\n\n## Tools\n\n", 64


def parsed(files: DataFrame, formats: Formats = DEFAULT) -> DataFrame:
    """Header fields of (rel_path, content) as columns, ``body``, ``body_line`` and ``parses``.

    Unknown header keys are let through; a required one that is missing, repeated or ill-formed is not.
    """
    lines = F.split("content", "\n")
    # The closing line must itself end, so the last piece of the split doesn't count.
    close = F.array_position(F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0))), "---")
    out = files.withColumn("close_", close).withColumn("head_", F.when((close > 0) & F.startswith("content", F.lit("---\n")), F.slice(lines, 2, (close - 1).cast("int"))))
    pairs = F.transform("head_", lambda s: F.struct(F.substring_index(s, ": ", 1).alias("k"), F.substring(s, F.instr(s, ": ") + 2, F.length(s)).alias("v")))
    out = out.withColumn("pairs_", pairs)
    values = lambda k: F.filter("pairs_", lambda p: p["k"] == k)
    value = lambda k: F.try_element_at(values(k), F.lit(-1))["v"]
    number = lambda c: F.when(c.rlike(r"\A[0-9]{1,18}\z"), c.cast("long"))
    good = F.col("head_").isNotNull() & F.forall("head_", lambda s: F.contains(s, F.lit(": "))) & (value("schema") == formats.schema)
    for k in REQUIRED:
        good = good & (F.size(values(k)) == 1)
    for k in ("harness", "session_id", "turn_id", "capture_policy", "turn_outcome"):
        good = good & is_token(value(k))
    good = good & is_world(value("world")) & is_scope(value("scope")) & value("lane").isin(*LANES)
    good = good & number(value("event_time_ms")).isNotNull() & number(value("capture_time_ms")).isNotNull() & value("payload_digest").rlike(r"\Asha256:[\s\S]{64}\z")
    return out.select(
        *files.columns,
        *[value(k).alias(k) for k in REQUIRED if k not in ("event_time_ms", "capture_time_ms", "payload_digest")],
        number(value("event_time_ms")).alias("event_time_ms"),
        number(value("capture_time_ms")).alias("capture_time_ms"),
        F.substring(value("payload_digest"), 8, 64).alias("recorded_digest"),
        (F.col("close_") + 2).cast("int").alias("body_line"),
        F.array_join(F.slice(lines, (F.col("close_") + 2).cast("int"), F.size(lines)), "\n").alias("body"),
        F.coalesce(good, F.lit(False)).alias("parses"),
    )


_ASSISTANT_AT, _TOOLS_AT = (re.compile(f"(?={re.escape(mark)})") for mark in (ASSISTANT, TOOLS))
_LISTED = re.compile(r"(?:- [A-Za-z0-9._:+/@-]{1,128}\n)+")


def _splits(region: str) -> Iterator[tuple[int, int, list[str]]]:
    """(where the assistant's mark begins, where its text ends, tool names) of every way to read a body's rest."""
    marks = [m.start() for m in islice(_ASSISTANT_AT.finditer(region), MAX_READINGS)]
    lists = [(m.start(), region[m.start() + len(TOOLS) :]) for m in _TOOLS_AT.finditer(region)]
    ends = [(at, [name[2:] for name in listed.splitlines()]) for at, listed in lists if _LISTED.fullmatch(listed)]
    if region.endswith("\n"):
        ends.insert(0, (len(region) - 1, []))  # without tools, before the readings with some
    for mark in marks:
        yield from ((mark, end, names) for end, names in ends if end >= mark + len(ASSISTANT))


def readings(body: str) -> list[dict]:
    """Ways to split a body into user text, assistant text and tools, in the order of rendering.

    Section marks may also stand inside the texts. At most 64 splits and 64 readings are looked at.
    """
    region = body.removeprefix(USER)
    if len(region) == len(body):
        return []
    return [
        {"user_content": region[:mark], "assistant_result": region[mark + len(ASSISTANT) : end], "tools": names}
        for mark, end, names in islice(_splits(region), MAX_READINGS)
    ]


READING = "array<struct<user_content:string,assistant_result:string,tools:array<string>>>"


def with_readings(records: DataFrame) -> DataFrame:
    """Add ``readings`` of ``body``; the search through texts with marks inside is what SQL can't say."""
    kind = pa.list_(pa.struct([("user_content", pa.string()), ("assistant_result", pa.string()), ("tools", pa.list_(pa.string()))]))
    at = records.columns.index("body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([readings(b or "") for b in batch.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "readings"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
    return records.mapInArrow(run, f"{fields}, readings {READING}")


def digest_probe(content: Column) -> Column:
    """The digest that a record's header names, without looking at anything else; null if there is none."""
    head = F.regexp_extract(content, r"\A---\n(?s:(.*?))\n---\n", 1)
    return F.nullif(F.regexp_extract(head, r"(?m)^payload_digest: sha256:([0-9a-f]{64})$", 1), F.lit(""))


def header_value(content: Column | str, name: str) -> Column:
    """The last value of a header line by its name, without looking at anything else; null if there is none."""
    head = F.regexp_extract(content, r"\A---\n(?s:(.*?))\n---\n", 1)
    return F.try_element_at(F.regexp_extract_all(head, F.lit(rf"(?m)^{name}: (.*)$"), F.lit(1)), F.lit(-1))


def _digest_of(reading: Column, formats: Formats) -> Column:
    return payload_digest(formats, **{n: reading[n] for n in ("user_content", "assistant_result", "tools")})


def verified(files: DataFrame, formats: Formats = DEFAULT) -> DataFrame:
    """``parsed`` with ``verify_status`` (ok, malformed, digest_mismatch), the agreeing reading's texts and tools,
    and ``reseal_digest``, the digest of the first reading where the record is well-formed."""
    r = with_readings(parsed(files, formats))
    # The recorded id must be the one that the header's own fields give.
    identity = F.coalesce(episode_id(formats=formats) == F.col("episode_id"), F.lit(False))
    agreeing = F.filter("readings", lambda x: _digest_of(x, formats) == F.col("recorded_digest"))
    r = r.withColumn("agree_", F.try_element_at(agreeing, F.lit(1)))
    sound = F.col("parses") & identity & (F.size("readings") > 0)
    status = (
        F.when(~F.col("parses"), "malformed")
        .when(~identity, "digest_mismatch")
        .when(F.size("readings") == 0, "malformed")
        .when(F.col("agree_").isNull(), "digest_mismatch")
        .otherwise("ok")
    )
    first = F.when(sound, _digest_of(F.try_element_at("readings", F.lit(1)), formats))
    return r.withColumn("verify_status", status).withColumn("reseal_digest", first).select("*", "agree_.*").drop("agree_", "readings")


def reseal_preview(files: DataFrame, formats: Formats = DEFAULT) -> DataFrame:
    """What re-attesting would do: rel_path, action (current, reseal, refuse) and the content to be written."""
    v = verified(files, formats)
    action = F.when(F.col("reseal_digest").isNull(), "refuse").when(F.col("verify_status") == "ok", "current").otherwise("reseal")
    old = F.concat(F.lit("payload_digest: sha256:"), F.col("recorded_digest"))
    new = F.concat(F.lit("payload_digest: sha256:"), F.col("reseal_digest"))
    at = F.instr("content", old)
    written = F.concat(F.substring("content", F.lit(1), at - 1), new, F.substring("content", at + F.length(old), F.length("content")))
    return v.select("rel_path", action.alias("action"), F.when(action == "reseal", written).otherwise(F.col("content")).alias("content"))
