"""Payloads out of turns that were read from logs, and the account of an import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.contracts import is_path
from strandline.functions.text import host_label, truncated

#: Shortest prompt that is worth a record.
LEAST = 3


def _or_null(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def payloads(turns: DataFrame, harness: str, adapter_version: str, policy: str, now_ms: int, lane: str = "conversation", outcome: str = "completed") -> DataFrame:
    """The contract's columns for (session_id, turn_id, user_content, assistant_result), other columns kept.

    Turns may also have event_time_ms, tools, lane, turn_outcome, cwd (kept as workspace_root if it is a path
    of the contract) and host. Long texts are cut and say so. Turns whose prompt is shorter than three
    characters, or that have no reply, are left out.
    """
    said = lambda c: F.length(F.regexp_replace(c, r"\A\s+|\s+\z", ""))
    kept = turns.filter((said("user_content") >= LEAST) & (said("assistant_result") > 0))
    new = {
        "schema_version": F.lit(1).cast("long"),
        "lane": F.coalesce(_or_null(turns, "lane"), F.lit(lane)),
        "harness": F.coalesce(_or_null(turns, "harness"), F.lit(harness)),
        "adapter_version": F.lit(adapter_version),
        "event_time_ms": F.coalesce(_or_null(turns, "event_time_ms", "long"), F.lit(now_ms)),
        "capture_policy": F.lit(policy),
        "turn_outcome": F.coalesce(_or_null(turns, "turn_outcome"), F.lit(outcome)),
        "user_content": truncated(F.col("user_content")),
        "assistant_result": truncated(F.col("assistant_result")),
        "tools": F.coalesce(_or_null(turns, "tools", "array<string>"), F.array().cast("array<string>")),
        "workspace_root": F.when(is_path(_or_null(turns, "cwd")), _or_null(turns, "cwd")),
        "host": host_label(_or_null(turns, "host")),
        "world": _or_null(turns, "world"),
        "scope": _or_null(turns, "scope"),
        "branch_of": _or_null(turns, "branch_of"),
    }
    return kept.withColumns(new)


def import_counts(sessions: DataFrame, turns: DataFrame, decided: DataFrame) -> DataFrame:
    """The account of an import in one row.

    ``sessions`` has (session, skip_reason) with null for those that were read, ``turns`` their turns with
    ``skip``, and ``decided`` the outcomes of what was delivered.
    """
    outcome = F.col("outcome")
    files = sessions.agg(F.count_if(F.col("skip_reason").isNull()).alias("files"), F.count_if(F.col("skip_reason").isNotNull()).alias("skipped_files"))
    skipped = turns.agg(F.count_if("skip").alias("skipped_turns"))
    done = decided.agg(
        F.count_if(outcome.isin("published", "superseded")).alias("published"),
        F.count_if(outcome.isin("duplicate", "conflict")).alias("existing"),
        F.count_if(~outcome.isin("published", "superseded", "duplicate", "conflict")).alias("failed"),
    )
    return files.join(skipped).join(done)  # three rows of one
