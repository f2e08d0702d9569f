"""Payload parts from session logs: recorded transcripts and legacy notes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.contracts import is_token

# Tags of blocks that a program put into a prompt, and record types of legacy notes.
SYNTHETIC_TAGS = ("task-notification", "local-command-caveat", "local-command-stdout", "command-name", "command-message", "command-args", "system-reminder")
MACHINE_HEADS = ("task-notification", "local-command-caveat", "local-command-stdout", "system-reminder")
LEGACY_TYPES = {"conversation": "imported-conversation", "conversation_journal": "imported-conversation", "delegated_work": "imported-delegated-work"}


_TAGS = "|".join(SYNTHETIC_TAGS)
#: Blocks at the head, one after the other; one that isn't closed goes on to the end.
_HEAD = re.compile(rf"\A(?:\s*<({_TAGS})>(?:(?:(?!</\1>).)*</\1>|.*))*\s*", re.DOTALL)
_CLOSED = tuple(f"</{t}>" for t in SYNTHETIC_TAGS)


def strip_synthetic(text: str) -> str:
    """A prompt without the tagged blocks at its two ends; an open one at the head takes all.

    A block at the end begins at the last place where its tag opens. Every character is looked at a few times.
    """
    rest = _HEAD.sub("", text, count=1)
    end = len(rest.rstrip())
    while rest.endswith(_CLOSED, 0, end):
        tag = rest[rest.rfind("</", 0, end) + 2 : end]
        begin = rest.rfind(f"<{tag}", 0, end)
        if begin < 0:
            break
        while begin and rest[begin - 1].isspace():
            begin -= 1
        end = begin
    return rest[:end].strip()


def _inner(text: str, tag: str) -> str:
    _, opened, rest = text.partition(f"<{tag}>")
    inside, closed, _ = rest.partition(f"</{tag}>")
    return inside.strip() if opened and closed else ""


def entry(raw: str) -> dict | None:
    """One log line as kind (owner, envelope, machine, assistant, other), text, terminal flag, tools, id; None if it isn't JSON."""
    try:
        o = json.loads(raw)
    except ValueError:
        return None
    if not isinstance(o, dict):
        return None
    message = o.get("message") if isinstance(o.get("message"), dict) else {}
    content = message.get("content")
    blocks = [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []
    texts = [content] if isinstance(content, str) else [b.get("text") or "" for b in blocks if b.get("type") == "text"]
    uuid = o.get("uuid")
    out = {"uuid": uuid if isinstance(uuid, str) and uuid else None, "timestamp": o.get("timestamp") if isinstance(o.get("timestamp"), str) else None, "tools": [], "terminal": False, "text": ""}
    if o.get("type") == "user":
        text = "\n".join(texts)
        head = text.lstrip()
        machine = any(b.get("type") == "tool_result" for b in blocks) or o.get("isMeta") or o.get("isSidechain") or not head or any(head.startswith(f"<{t}>") for t in MACHINE_HEADS)
        if machine:
            return out | {"kind": "machine"}
        if head.startswith(("<command-name>", "<command-message>")):
            return out | {"kind": "envelope", "text": _inner(text, "command-args") or _inner(text, "command-name")}
        return out | {"kind": "owner", "text": strip_synthetic(text)}
    if o.get("type") == "assistant" and not o.get("isSidechain"):
        said = [t.strip() for t in texts if t.strip()]
        names = [b["name"] for b in blocks if b.get("type") == "tool_use" and isinstance(b.get("name"), str)]
        return out | {"kind": "assistant", "text": "\n".join(said), "terminal": message.get("stop_reason") == "end_turn" and bool(said), "tools": names}
    return out | {"kind": "other"}


def logs(spark: SparkSession, paths: str) -> DataFrame:
    """(session, line_no, value) of log files, one JSON object a line; a session is named by its file.

    Large files are read in pieces. Of files of one name in several folders the first by path counts.
    """
    at = {"session": F.regexp_replace("_metadata.file_name", r"\.[^.]*$", ""), "path_": F.col("_metadata.file_path"), "block_": F.col("_metadata.file_block_start"), "row_": F.monotonically_increasing_id()}
    lines = spark.read.text(paths).withColumns(at)
    by = Window.partitionBy("session")
    first = lines.withColumn("first_", F.min("path_").over(by)).filter("path_ = first_")
    return first.select("session", F.row_number().over(by.orderBy("block_", "row_")).cast("long").alias("line_no"), "value")


ENTRY = "kind string, text string, terminal boolean, tools array<string>, uuid string, timestamp string"


def entries(lines: DataFrame) -> DataFrame:
    """Entries of (session, line_no, value); lines that aren't whole are left out."""
    kinds = {"kind": pa.string(), "text": pa.string(), "terminal": pa.bool_(), "tools": pa.list_(pa.string()), "uuid": pa.string(), "timestamp": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [entry(v or "") for v in batch.column(2).to_pylist()]
            keep = pa.array([r is not None for r in rows], pa.bool_())
            found = [r for r in rows if r is not None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep), *(pa.array([r[n] for r in found], k) for n, k in kinds.items())],
                names=["session", "line_no", *kinds],
            )

    return lines.select("session", F.col("line_no").cast("long"), "value").mapInArrow(run, f"session string, line_no long, {ENTRY}")


def completed_turns(found: DataFrame) -> DataFrame:
    """Turns of ``entries``: from what the owner typed to the next such entry, with all terminal texts in order."""
    by = Window.partitionBy("session").orderBy("line_no")
    starts = F.col("kind").isin("owner", "envelope")
    at = found.withColumn("index", F.row_number().over(by) - 1).withColumn("turn", F.sum(starts.cast("long")).over(by)).filter("turn > 0")
    ends = F.array_sort(F.collect_list(F.when(F.col("terminal"), F.struct("line_no", "text"))))
    named = F.array_sort(F.collect_list(F.when(F.col("kind") == "assistant", F.struct("line_no", "tools"))))
    turns = at.groupBy("session", "turn").agg(
        F.min_by("text", "line_no").alias("user_content"),
        F.coalesce(F.min_by("uuid", "line_no"), F.concat(F.lit("idx"), F.min("index").cast("string"))).alias("turn_id"),
        F.min_by("timestamp", "line_no").alias("timestamp"),
        F.array_join(F.transform(ends, lambda e: e["text"]), "\n\n").alias("assistant_result"),
        F.array_distinct(F.filter(F.flatten(F.transform(named, lambda e: e["tools"])), lambda t: is_token(t))).alias("tools"),
    )
    return turns.filter((F.length("user_content") >= 3) & (F.col("assistant_result") != "")).withColumn("event_time_ms", F.unix_millis(F.try_to_timestamp("timestamp")))


def legacy_turns(files: DataFrame, zone: str = "UTC") -> DataFrame:
    """Pairs of user and agent parts of legacy notes (rel_path, content); files of another shape give none.

    Markers must alternate from User to Agent; a file with an empty part is left out as a whole.
    """
    lines = files.select("rel_path", F.posexplode(F.split("content", "\n")).alias("no", "line"))
    mark = r"\A\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\] \[(User|Agent)\]\z"
    by = Window.partitionBy("rel_path").orderBy("no")
    marked = lines.withColumn("role", F.when(F.col("line").rlike(mark), F.regexp_extract("line", mark, 2))).withColumn("part", F.count("role").over(by))
    header = lines.filter(F.col("line").rlike(r"\A[A-Za-z_]+:")).select("rel_path", "no", F.regexp_extract("line", r"\A([A-Za-z_]+):\s*(.*)\z", 1).alias("k"), F.trim(F.translate(F.regexp_extract("line", r"\A([A-Za-z_]+):\s*(.*)\z", 2), '"', "")).alias("v"))
    close = lines.filter((F.col("line") == "---") & (F.col("no") > 0)).groupBy("rel_path").agg(F.min("no").alias("close"))
    opened = lines.filter((F.col("no") == 0) & (F.col("line") == "---")).select("rel_path")
    first = lambda k: F.max_by(F.when(F.col("k") == k, F.col("v")), F.when(F.col("k") == k, F.col("no")))
    heads = header.join(close, "rel_path").join(opened, "rel_path").filter(F.col("no") < F.col("close")).groupBy("rel_path").agg(
        F.coalesce(F.nullif(first("type"), F.lit("")), first("kind")).alias("type"), first("session_id").alias("session_id"), first("harness").alias("harness"), F.first("close").alias("close")
    )
    outcome = F.create_map(*[F.lit(x) for p in LEGACY_TYPES.items() for x in p])
    heads = heads.withColumn("turn_outcome", outcome[F.col("type")]).filter(F.col("turn_outcome").isNotNull() & (F.col("session_id") != "") & (F.col("harness") != ""))
    body = marked.join(heads, "rel_path").filter((F.col("no") > F.col("close")) & (F.col("part") > 0))
    parts = body.groupBy("rel_path", "part").agg(
        F.max("role").alias("role"),
        F.max(F.when(F.col("role").isNotNull(), F.regexp_extract("line", mark, 1))).alias("stamp"),
        F.array_sort(F.collect_list(F.when(F.col("role").isNull(), F.struct("no", "line")))).alias("lines"),
    )
    quoted = F.transform("lines", lambda x: F.when((F.col("role") == "Agent") & x["line"].startswith("> "), F.substring(x["line"], 3, 1 << 30)).when((F.col("role") == "Agent") & (x["line"] == ">"), F.lit("")).otherwise(x["line"]))
    parts = parts.withColumn("text", F.regexp_replace(F.array_join(quoted, "\n"), r"\A\s+|\s+\z", ""))
    right = (F.col("role") == F.when(F.col("part") % 2 == 1, "User").otherwise("Agent")) & (F.col("text") != "")
    whole = parts.groupBy("rel_path").agg(F.bool_and(right).alias("good"), F.count("*").alias("n")).filter(F.col("good") & (F.col("n") % 2 == 0)).select("rel_path")
    pairs = parts.join(whole, "rel_path").withColumn("pair", F.floor((F.col("part") + 1) / 2)).groupBy("rel_path", "pair").agg(
        F.max(F.when(F.col("role") == "User", F.col("text"))).alias("user_content"),
        F.max(F.when(F.col("role") == "Agent", F.col("text"))).alias("assistant_result"),
        F.max(F.when(F.col("role") == "User", F.col("stamp"))).alias("stamp"),
    )
    return pairs.join(heads.drop("close", "type"), "rel_path").select(
        "rel_path", "session_id", "harness", F.lit("imported_legacy").alias("lane"), "turn_outcome", F.format_string("legacy-%04d", "pair").alias("turn_id"),
        F.unix_millis(F.to_utc_timestamp(F.to_timestamp("stamp", "yyyy-MM-dd HH:mm:ss"), zone)).alias("event_time_ms"), "user_content", "assistant_result",
    )
