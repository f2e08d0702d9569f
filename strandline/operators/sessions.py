"""Turns out of session logs that carry a header, messages and a capture policy."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POLICY_TYPE = "session-policy"


def _time_ms(value) -> int | None:
    if not isinstance(value, str):
        return None
    try:
        at = datetime.fromisoformat(value.replace("Z", "+00:00"))
    except ValueError:
        return None
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def entry(raw: str, policy_type: str = POLICY_TYPE) -> dict:
    """One log line: kind (header, policy, user, assistant, broken, other), id, time, text, tool names, policy."""
    none = {"kind": "other", "id": None, "time_ms": None, "text": "", "tools": [], "policy": None}
    try:
        o = json.loads(raw)
    except ValueError:
        return none | {"kind": "broken"}
    if not isinstance(o, dict):
        return none
    if o.get("type") == "session":
        return none | {"kind": "subagent" if "parentSession" in o else "header"}
    if o.get("type") == "custom" and o.get("customType") == policy_type:
        capture = (o.get("data") or {}).get("capture")
        return none | {"kind": "policy", "policy": capture if capture in ("on", "off") else None}
    message = o.get("message")
    if o.get("type") != "message" or not isinstance(message, dict) or message.get("role") not in ("user", "assistant"):
        return none
    content = message.get("content")
    blocks = [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []
    texts = [content] if isinstance(content, str) else [b["text"] for b in blocks if b.get("type") == "text" and isinstance(b.get("text"), str)]
    at = _time_ms(o.get("timestamp"))
    if at is None:
        at = int(message["timestamp"]) if isinstance(message.get("timestamp"), (int, float)) else 0
    return {
        "kind": message["role"],
        "id": o["id"] if isinstance(o.get("id"), str) and o["id"] else None,
        "time_ms": at,
        "text": "\n".join(t for t in texts if t.strip()),
        "tools": [b["name"] for b in blocks if b.get("type") in ("toolCall", "tool_use") and isinstance(b.get("name"), str)],
        "policy": None,
    }


def session_turns(lines: DataFrame, policy_type: str = POLICY_TYPE) -> DataFrame:
    """One row per turn of (session, line_no, value), with ``skip`` where it isn't to be captured.

    A turn begins where a user message follows an assistant's. Its id, time and policy are those of its
    last assistant entry, so that a later change of policy doesn't reach back. Logs that don't begin with
    a header, or with that of a subagent, give nothing.
    """
    kinds = {"kind": pa.string(), "id": pa.string(), "time_ms": pa.int64(), "text": pa.string(), "tools": pa.list_(pa.string()), "policy": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [entry(v or "", policy_type) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[n] for r in rows], k) for n, k in kinds.items())], names=["session", "line_no", *kinds])

    found = lines.filter(F.trim("value") != "").select("session", F.col("line_no").cast("long"), "value")
    found = found.mapInArrow(run, "session string, line_no long, kind string, id string, time_ms long, text string, tools array<string>, policy string")
    by = Window.partitionBy("session").orderBy("line_no")
    seen = found.withColumn("first", F.first("kind").over(by)).withColumn("in_force", F.coalesce(F.last("policy", ignorenulls=True).over(by), F.lit("on")))
    said = seen.filter((F.col("first") == "header") & F.col("kind").isin("user", "assistant"))
    begins = (F.col("kind") == "user") & (F.lag("kind").over(by) == "assistant")
    said = said.withColumn("turn", F.sum(F.coalesce(begins, F.lit(False)).cast("long")).over(by))
    user, reply = F.col("kind") == "user", F.col("kind") == "assistant"
    asked = F.array_sort(F.collect_list(F.when(user & (F.col("text") != ""), F.struct("line_no", "text"))))
    named = F.array_sort(F.collect_list(F.when(F.size("tools") > 0, F.struct("line_no", "tools"))))
    turns = said.groupBy("session", "turn").agg(
        F.array_join(F.transform(asked, lambda e: e["text"]), "\n\n").alias("user_content"),
        F.coalesce(F.max_by("text", F.when(reply & (F.col("text") != ""), F.col("line_no"))), F.lit("")).alias("assistant_result"),
        F.array_distinct(F.flatten(F.transform(named, lambda e: e["tools"]))).alias("tools"),
        F.max_by("id", F.when(reply & F.col("id").isNotNull(), F.col("line_no"))).alias("turn_id"),
        F.max_by("time_ms", F.when(reply, F.col("line_no"))).alias("event_time_ms"),
        F.max_by("in_force", F.when(reply, F.col("line_no"))).alias("policy"),
    )
    whole = (F.col("policy") == "on") & F.col("turn_id").isNotNull() & (F.col("event_time_ms") > 0) & (F.col("user_content") != "") & (F.col("assistant_result") != "")
    return turns.withColumn("skip", ~F.coalesce(whole, F.lit(False)))


def skip_reasons(lines: DataFrame) -> DataFrame:
    """(session, skip_reason) of (session, line_no, value): why a log gives no turns, or null if it is read.

    A log is left out if nothing stands in it, if its first line is no header, or if that is a subagent's.
    """
    head = lines.groupBy("session").agg(F.min_by("value", F.when(F.trim("value") != "", F.col("line_no"))).alias("head"))
    kind, parent = (F.try_variant_get(F.try_parse_json("head"), path, "string") for path in ("$.type", "$.parentSession"))
    subagent = F.contains("head", F.lit('"parentSession"')) & (F.try_variant_get(F.try_parse_json("head"), "$.parentSession", "variant").isNotNull() | parent.isNotNull())
    reason = F.when(F.col("head").isNull(), "empty").when(~F.coalesce(kind == "session", F.lit(False)), "no_header").when(subagent, "subagent")
    return head.select("session", reason.alias("skip_reason"))


def session_token(name, fallback: str = "session"):
    """A file's name as a token: other characters become dashes, at most 128 remain."""
    clean = F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._:+/@-]", "-"), 1, 128)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))
