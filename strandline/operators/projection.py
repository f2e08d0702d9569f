"""The derived relations of a corpus: lines, postings, document frequencies and trigrams.

Each is a plain function of the records, so a projection can be built anew at any time; ``sync_report``
says what a rebuild would change. Records have episode_id, rel_path, world, scope, lane, event_time_ms,
content and body_line (the 1-based line at which the body begins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import MAX_VOCABULARY, MIN_NEEDLE, index_tokens, trigrams


def body_lines(records: DataFrame) -> DataFrame:
    """Every body line with its number in the whole file."""
    at = F.posexplode(F.split("content", "\n")).alias("pos", "line")
    out = records.select(*[c for c in records.columns if c != "content"], at).withColumn("line_no", (F.col("pos") + 1).cast("int"))
    return out.filter(F.col("line_no") >= F.col("body_line")).drop("pos")


def postings(records: DataFrame, *more: str) -> DataFrame:
    """Distinct (world, lane, term, episode_id, line_no, and the columns ``more``) of records of distinct ids.

    A line brings each term once, so nothing has to be shuffled; take ``first_copies`` where ids repeat.
    """
    terms = F.explode(F.array_distinct(index_tokens(F.col("line")))).alias("term")
    return body_lines(records).select("world", "lane", "episode_id", "line_no", *more, terms)


def term_stats(posted: DataFrame) -> DataFrame:
    """(world, term) with the number of episodes outside and inside the evaluation lane."""
    each = posted.select("world", "lane", "term", "episode_id").distinct()
    inside = F.col("lane") == "evaluation"
    return each.groupBy("world", "term").agg(F.count_if(~inside).alias("df"), F.count_if(inside).alias("eval_df"))


def term_stats_of(records: DataFrame, *more: str) -> DataFrame:
    """The same, by the columns ``more``, too, straight from records of distinct ids: each brings a term once, so one aggregation is enough."""
    lines = F.split("content", "\n")
    body = F.when(F.col("body_line") <= 1, F.col("content")).otherwise(F.array_join(F.slice(lines, F.greatest(F.col("body_line"), F.lit(1)), F.size(lines)), "\n"))
    terms = records.select("world", "lane", *more, F.explode(F.array_distinct(index_tokens(body))).alias("term"))
    inside = F.col("lane") == "evaluation"
    return terms.groupBy("world", *more, "term").agg(F.count_if(~inside).alias("df"), F.count_if(inside).alias("eval_df"))


def term_trigrams(stats: DataFrame) -> DataFrame:
    return stats.select("world", F.explode(trigrams(F.col("term"))).alias("trigram"), "term")


def new_vocabulary(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """(world, term) of fresh statistics that the known ones lack."""
    return fresh.select("world", "term").join(known, ["world", "term"], "left_anti")


def dying_terms(stats: DataFrame, removed: DataFrame) -> DataFrame:
    """Terms of ``stats`` that stand in removed postings and, once these are counted out, in no other episode."""
    gone = removed.select("world", "term", "episode_id").distinct().groupBy("world", "term").agg(F.count("*").alias("gone"))
    held = F.col("df") + F.col("eval_df")
    same = stats["world"].eqNullSafe(gone["world"]) & (stats["term"] == gone["term"]) & (held == gone["gone"])
    return stats.join(gone, same, "left_semi").select("world", "term")


def candidates_by_scan(stats: DataFrame, world: str, needles: list[str]) -> DataFrame:
    """The first terms, in order, that contain any needle."""
    hit = F.exists(F.array(*map(F.lit, needles)), lambda n: F.contains(F.col("term"), n))
    return stats.filter((F.col("world") == world) & hit).select("term").orderBy("term").limit(MAX_VOCABULARY)


def candidates_by_trigrams(stats: DataFrame, grams: DataFrame, world: str, needles: list[str]) -> DataFrame:
    """The same by relational division: terms that hold every trigram of a needle, then the needle itself."""
    spark = stats.sparkSession
    parts = [(n, g, len({n[i : i + 3] for i in range(len(n) - 2)})) for n in needles if len(n) >= MIN_NEEDLE for g in {n[i : i + 3] for i in range(len(n) - 2)}]
    wanted = spark.createDataFrame(parts, "needle string, trigram string, k int")
    live = grams.filter(F.col("world") == world).join(stats.select("world", "term"), ["world", "term"], "left_semi")
    full = live.join(F.broadcast(wanted), "trigram").groupBy("needle", "term").agg(F.count("*").alias("n"), F.first("k").alias("k"))
    exact = full.filter((F.col("n") == F.col("k")) & F.contains(F.col("term"), F.col("needle")))
    return exact.select("term").distinct().orderBy("term").limit(MAX_VOCABULARY)


def posting_pairs(posted: DataFrame, terms: list[str]) -> DataFrame:
    """Distinct (episode_id, line_no) with any of the terms (at most the vocabulary cap of them)."""
    wanted = posted.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    return posted.join(F.broadcast(wanted), "term", "left_semi").select("episode_id", "line_no").distinct()


def postings_for_term(posted: DataFrame, records: DataFrame, term: str, world: str, scope: str | None, lanes: list[str]) -> DataFrame:
    """Postings of one term with their records' metadata."""
    keep = (F.col("world") == world) & F.col("lane").isin(lanes)
    if scope is not None:
        keep = keep & (F.col("scope") == scope)
    meta = records.filter(keep).select("episode_id", "rel_path", "scope", "lane", "event_time_ms")
    return posted.filter(F.col("term") == term).select("episode_id", "line_no").join(meta, "episode_id")


def first_copies(records: DataFrame) -> DataFrame:
    """One record of each id: the first in walk order, that is, by path components."""
    place = Window.partitionBy("episode_id").orderBy(F.split("rel_path", "/"))
    return records.withColumn("copy", F.row_number().over(place)).filter("copy = 1").drop("copy")


def change_status(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Each path of either side as unchanged, new, edited or vanished; both have rel_path and file_hash."""
    both = files.select("rel_path", F.col("file_hash").alias("now")).join(stored.select("rel_path", F.col("file_hash").alias("then")), "rel_path", "full_outer")
    return both.select(
        "rel_path",
        F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "vanished").when(F.col("now") == F.col("then"), "unchanged").otherwise("edited").alias("status"),
    )


def sync_report(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Counts of ``change_status`` in one row, and whether the projection matches the corpus."""
    s = F.col("status")
    return change_status(files, stored).agg(
        *[F.count_if(s == n).alias(n) for n in ("unchanged", "new", "edited", "vanished")],
        F.coalesce(F.bool_and(s == "unchanged"), F.lit(True)).alias("matches"),
    )


def freshness(files: DataFrame, stored: DataFrame, excluded: int = 0) -> DataFrame:
    """current if the hashes agree and indexed plus excluded records are all files, else stale."""
    report = sync_report(files, stored).select("matches", (F.col("unchanged") + F.col("new") + F.col("edited")).alias("source"), (F.col("unchanged") + F.col("edited") + F.col("vanished")).alias("indexed"))
    good = F.col("matches") & (F.col("indexed") + excluded == F.col("source"))
    return report.withColumn("freshness", F.when(good, "current").otherwise("stale"))


def catalog(records: DataFrame, world: str = "main", scope: str = "default") -> DataFrame:
    """Distinct (world, scope), the default pair first whether or not it occurs."""
    spark = records.sparkSession
    default = spark.createDataFrame([(world, scope, True)], "world string, scope string, is_default boolean")
    others = records.select("world", "scope").distinct().join(default, ["world", "scope"], "left_anti").withColumn("is_default", F.lit(False))
    return default.unionByName(others)
