"""Reports over a corpus: machine-made text by session, weak queries, retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import ascii_lower, line_kind, line_words, stripped

# How a user part begins that a program wrote.
SYNTHETIC = ("<task-notification>", "<local-command", "<command-name>", "<system-")


def classified(lines: DataFrame) -> DataFrame:
    """``lines`` with their ``kind``; a line is stripped and cut into words once, not in every branch."""
    cut = lines.withColumn("s_", stripped(F.col("line"))).withColumn("w_", line_words(F.col("s_")))
    return cut.withColumn("kind", line_kind(F.col("s_"), F.col("w_"))).drop("s_", "w_")


def junk_by_session(lines: DataFrame, records: DataFrame, session: str = "session_id", min_bytes: int = 4096) -> DataFrame:
    """Per session: shares of line kinds, share of repeated lines, and junk (share and mass in bytes).

    ``lines`` and ``records`` carry the session; records also ``content`` and ``user_content``. Distinct lines are counted by hash.
    """
    kinds = ("prose", "tool", "blob", "other")
    seen = classified(lines.select(session, "line")).filter(F.col("kind") != "blank")
    counts = seen.groupBy(session).agg(
        F.count("*").alias("content_lines"),
        F.count_distinct(F.xxhash64("line")).alias("distinct_lines"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds],
    )
    opening = F.ltrim(F.regexp_replace("user_content", r"\A\s+", ""))
    machine = F.lit(False)
    for s in SYNTHETIC:
        machine = machine | opening.startswith(s)
    sizes = records.groupBy(session).agg(F.count("*").alias("episodes"), F.sum(F.octet_length("content")).alias("bytes"), F.count_if(F.coalesce(machine, F.lit(False))).alias("synthetic"))
    both = counts.join(sizes.filter(F.col("bytes") >= min_bytes), session)
    unique, prose = F.col("distinct_lines") / F.col("content_lines"), F.col("prose") / F.col("content_lines")
    junk = F.greatest((1 - prose) * (2 - unique) / 2, F.col("synthetic") / F.col("episodes"))
    return both.select(session, "episodes", "bytes", "content_lines", "distinct_lines", *kinds, junk.alias("junk"), (junk * F.col("bytes")).alias("junk_bytes"))


def weak_queries(log: DataFrame) -> DataFrame:
    """Weak queries by their lower-cased, trimmed text: how often, and all their terms in order."""
    return (
        log.withColumn("query", ascii_lower(F.trim("query")))
        .filter(F.col("query") != "")
        .groupBy("query")
        .agg(F.count("*").alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms"))
    )


def top_weak_queries(log: DataFrame, limit: int = 20) -> DataFrame:
    """The most frequent weak queries, ties in the order of their text."""
    return weak_queries(log).orderBy(F.desc("count"), "query").limit(limit)


def top_junk(sessions: DataFrame, session: str = "session_id", limit: int = 25) -> DataFrame:
    """The sessions of ``junk_by_session`` with the most machine-made text, ties in the order of their names."""
    return sessions.orderBy(F.desc("junk_bytes"), session).limit(limit)


def latest_by_session(entries: DataFrame, session: str, order: str, value: str) -> DataFrame:
    """The last valid value of each session."""
    return entries.filter(F.col(value).isNotNull()).groupBy(session).agg(F.max_by(value, order).alias(value))


def policy_at(entries: DataFrame, session: str, order: str, policy: str) -> DataFrame:
    """The policy in force at each entry: the last one set at or before it."""
    return entries.withColumn("in_force", F.last(policy, ignorenulls=True).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
