"""Cross-site boilerplate lines: distinct-site spread by HyperLogLog sketches, then removal.

Only DataFrame functions are used. A line's spread is the number of distinct sites whose documents
hold it. Lines seen fewer than ``min_sites`` times cannot reach the threshold and are left out with a
plain count; the others get one HyperLogLog sketch each, merged by the aggregation. Where the
estimate lies within ``band`` of the threshold, the exact distinct count decides instead. Every
occurrence of a boilerplate line but the first (smallest doc_id, then position) is removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, unused


def _line_key(line: Column) -> list[Column]:
    """128 bits of the line: two hashes with different seeds."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """128 bits of a row's id and text, so that no row meets another one's removals."""
    parts = [docs[id_col].cast("string"), docs[text_col]]
    return [F.xxhash64(*parts), F.xxhash64(F.lit("row"), *parts)]


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per non-blank line: row key, id, site, position and line key."""
    k1, k2 = _row_key(docs, id_col, text_col)
    return (
        docs.select(
            k1.alias("k1"),
            k2.alias("k2"),
            docs[id_col].alias("id"),
            # With a letter in front, as a sketch would pass over an empty name.
            F.coalesce(F.concat(F.lit("s"), docs[site_col].cast("string")), F.lit("-")).alias("site"),
            F.posexplode(F.split(docs[text_col], "\n")).alias("pos", "line"),
        )
        .filter(F.trim("line") != "")
        .select("k1", "k2", "id", "site", "pos", *_line_key(F.col("line")))
    )


def _spread_out(keys: DataFrame, salts: int) -> DataFrame:
    """Line keys once for each salt, so that the occurrences of a hot line meet them in several tasks."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def boilerplate(
    docs: DataFrame,
    min_sites: int = 10,
    band: float = 0.25,
    lg_k: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    salts: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """(occurrences of repeated lines with a salt, boilerplate lines with ``sites`` and first occurrence)."""
    lines = _lines(docs, id_col, text_col, site_col)
    key = ["h1", "h2"]
    often = lines.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select(*key)
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("k1", "pos"), F.lit(salts)).cast("int"))
    seen = checkpointed(salted.join(_spread_out(often, salts), [*key, "salt"], "left_semi"))
    spread = seen.groupBy(*key).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("estimate"),
        F.min(F.struct("id", "pos")).alias("first"),
    )
    near = F.abs(F.col("estimate") - min_sites) <= band * min_sites
    exact = (
        seen.join(_spread_out(spread.filter(near).select(*key), salts), [*key, "salt"], "left_semi")
        .select(*key, "site")
        .distinct()
        .groupBy(*key)
        .agg(F.count("*").alias("exact"))
    )
    wide = (
        spread.filter((F.col("estimate") >= min_sites) | near)
        .join(exact, key, "left")
        .select(*key, F.coalesce("exact", "estimate").alias("sites"), "first")
        .filter(F.col("sites") >= min_sites)
    )
    return seen, wide


def drop_boilerplate(
    docs: DataFrame,
    min_sites: int = 10,
    band: float = 0.25,
    lg_k: int = 12,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    salts: int = 16,
    counts: tuple[str, str] = ("n_lines", "n_removed"),
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, plus the ``counts`` of lines and of removed ones.

    A null text stays null with zero lines. A null site counts as one site of its own. Lines that are
    empty or of spaces alone are never boilerplate. Repeated rows (same id and text) count once for each
    row and lose the same lines. An empty table gives an empty result. Columns that have the names in
    ``counts`` are replaced; all others stay.
    """
    n_lines, n_removed = counts
    seen, wide = boilerplate(docs, min_sites, band, lg_k, id_col, text_col, site_col, salts)
    gone = (
        seen.join(_spread_out(wide.select("h1", "h2", "first"), salts), ["h1", "h2", "salt"])
        .filter(~F.col("first").eqNullSafe(F.struct("id", "pos")))
        .groupBy("k1", "k2")
        .agg(F.collect_set("pos").alias("gone"))
    )
    k1, k2, taken, cut = (unused(n, docs.columns) for n in ("_row1", "_row2", "_gone", "_lines"))
    keys = dict(zip((k1, k2), _row_key(docs, id_col, text_col)))
    kept = docs.withColumns(keys).drop(n_lines, n_removed)
    kept = kept.join(gone.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("gone").alias(taken)), [k1, k2], "left")
    # A column of its own: inside a lambda the text would be split anew for every line.
    kept = kept.withColumn(cut, F.split(F.col(text_col), "\n"))
    lines = F.col(cut)
    # Positions that stay, in order; the exception looks them up by hash, however many lines there are.
    rest = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(taken))
    rest = F.transform(rest, lambda i: F.get(lines, i))
    return kept.select(
        *[
            F.when(F.col(taken).isNull(), F.col(c)).otherwise(F.array_join(rest, "\n")).alias(c) if c == text_col else F.col(c)
            for c in docs.columns
            if c not in counts
        ],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n_lines),
        F.when(F.col(taken).isNull(), 0).otherwise(F.size(taken)).cast("long").alias(n_removed),
    )


def op7_line_dedup(spark, sf_dir):
    """Every document without its cross-site boilerplate lines: doc_id, text, n_lines, n_removed."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return drop_boilerplate(docs).select("doc_id", "text", "n_lines", "n_removed")


SQL = """
WITH lines AS (
  SELECT doc_id, source, line, pos FROM (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
    FROM documents)
), wide AS (
  SELECT line, min(struct_pack(id := doc_id, pos := pos)) AS first
  FROM lines WHERE trim(line) <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.doc_id, l.line, l.pos, w.line IS NOT NULL AND (w.first.id <> l.doc_id OR w.first.pos <> l.pos) AS gone
  FROM lines l LEFT JOIN wide w ON w.line = l.line
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
FROM marked GROUP BY doc_id
"""
