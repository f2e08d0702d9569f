"""The payload contract: strict parsing of delivered JSON and the ordered list of checks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lanes, budgets in bytes, and the latest time that a payload may carry.
LANES = ("conversation", "delegated_work", "evaluation", "imported_legacy")
MAX_PAYLOAD, MAX_CONTENT, MAX_TOOLS, MAX_PATH = 4 << 20, 2 << 20, 256, 512
MAX_EVENT_MS = 253402300799000

PAYLOAD = (
    "schema_version bigint, world string, scope string, lane string, harness string, adapter_version string, session_id string, "
    "turn_id string, event_time_ms bigint, capture_policy string, turn_outcome string, user_content string, assistant_result string, "
    "tools array<string>, workspace_root string, branch_of string, host string"
)
_REQUIRED_TEXT = ("lane", "harness", "adapter_version", "session_id", "turn_id", "capture_policy", "turn_outcome", "user_content", "assistant_result")
_OPTIONAL_TEXT = ("world", "scope", "workspace_root", "branch_of", "host")
_NUMBERS = ("schema_version", "event_time_ms")


def is_token(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[A-Za-z0-9._:+/@-]{1,128}\z"), F.lit(False))


def is_world(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[a-z0-9-]{1,64}\z"), F.lit(False))


def is_scope(c: Column) -> Column:
    return is_token(c) & ~F.contains(c, F.lit("/")) & ~c.startswith(".")


def is_path(c: Column) -> Column:
    return (F.octet_length(c) <= MAX_PATH) & (F.length(c) > 0) & ~c.rlike(r"[\x00-\x1f\x7f]")


def error_name() -> Column:
    """The first check that a payload fails, or null. The order is part of the contract."""
    c = F.col
    bad_optional = lambda n, ok: c(n).isNotNull() & ~ok(c(n))
    checks = [
        (~c("schema_version").eqNullSafe(F.lit(1)), "UnsupportedSchemaVersion"),
        (c("world").isNull(), "InvalidWorld"),
        (c("scope").isNull(), "InvalidScope"),
        (~is_world(c("world")), "InvalidWorld"),
        (~is_scope(c("scope")), "InvalidScope"),
        (~F.coalesce(c("lane").isin(*LANES), F.lit(False)), "InvalidLane"),
        (~F.coalesce(c("event_time_ms").between(0, MAX_EVENT_MS), F.lit(False)), "ImplausibleEventTime"),
        *((~is_token(c(n)), "Invalid" + e) for n, e in (("harness", "Harness"), ("adapter_version", "AdapterVersion"), ("session_id", "SessionID"), ("turn_id", "TurnID"), ("capture_policy", "CapturePolicy"), ("turn_outcome", "TurnOutcome"))),
        (F.coalesce(F.octet_length("user_content"), F.lit(0)) == 0, "EmptyUserContent"),
        (F.coalesce(F.octet_length("assistant_result"), F.lit(0)) == 0, "EmptyAssistantResult"),
        ((F.octet_length("user_content") > MAX_CONTENT) | (F.octet_length("assistant_result") > MAX_CONTENT), "OversizedContent"),
        (~F.is_valid_utf8("user_content") | ~F.is_valid_utf8("assistant_result"), "InvalidUTF8"),
        (F.size(F.coalesce("tools", F.array().cast("array<string>"))) > MAX_TOOLS, "TooManyTools"),
        (F.exists(F.coalesce("tools", F.array().cast("array<string>")), lambda t: ~is_token(t)), "InvalidToolName"),
        (bad_optional("workspace_root", is_path), "InvalidWorkspaceRoot"),
        (bad_optional("branch_of", is_path), "InvalidBranchOf"),
        (bad_optional("host", is_token), "InvalidHost"),
    ]
    return F.coalesce(*[F.when(bad, name) for bad, name in checks])


def with_defaults(payloads: DataFrame, world: str = "main", scope: str = "default") -> DataFrame:
    return payloads.withColumn("world", F.coalesce("world", F.lit(world))).withColumn("scope", F.coalesce("scope", F.lit(scope)))


class Malformed(ValueError):
    pass


class _Bare(str):
    """A number as it was written."""


def _closed(pairs: list) -> dict:
    seen = dict(pairs)
    if len(seen) != len(pairs):
        raise Malformed("duplicate key")
    return seen


def _digits(x) -> int:
    if not isinstance(x, _Bare) or not re.fullmatch("[0-9]+", x) or int(x) >= 1 << 63:
        raise Malformed("not a plain number")
    return int(x)


def parse(raw: str) -> dict:
    """One payload of a closed set of keys. Duplicate or unknown keys, other types and trailing text are errors."""
    if len(raw.encode()) > MAX_PAYLOAD:
        raise Malformed("oversized")
    try:
        top = json.loads(raw, object_pairs_hook=_closed, parse_int=_Bare, parse_float=_Bare, parse_constant=_Bare)
    except (ValueError, RecursionError) as e:
        raise Malformed(str(e)) from None
    if not isinstance(top, dict) or set(top) - {*_REQUIRED_TEXT, *_OPTIONAL_TEXT, *_NUMBERS, "tools"}:
        raise Malformed("unknown key or not an object")
    text = lambda x: isinstance(x, str) and not isinstance(x, _Bare)
    out: dict = {n: _digits(top.get(n)) for n in _NUMBERS}
    for n in _REQUIRED_TEXT:
        if not text(top.get(n)):
            raise Malformed(f"{n} is not text")
        out[n] = top[n]
    for n in _OPTIONAL_TEXT:
        if top.get(n) is not None and not text(top[n]):
            raise Malformed(f"{n} is not text")
        out[n] = top.get(n)
    tools = top.get("tools")
    if tools is not None and not (isinstance(tools, list) and all(isinstance(t, dict) and set(t) == {"name"} and text(t["name"]) for t in tools)):
        raise Malformed("tools are not names")
    out["tools"] = [t["name"] for t in tools or []]
    return out


def parse_payloads(raw: DataFrame, column: str = "value") -> DataFrame:
    """``raw`` with the contract's columns (replacing ones of their names) and ``malformed``; every row stays.

    JSON functions of SQL keep the last of two equal keys and take trailing text, hence the strict parser here.
    """
    names = [f.split()[0] for f in PAYLOAD.split(", ")]
    kinds = [pa.list_(pa.string()) if n == "tools" else pa.int64() if n in _NUMBERS else pa.string() for n in names]
    raw = raw.drop(*[n for n in (*names, "malformed") if n != column])
    at = raw.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, bad = [], []
            for r in batch.column(at).to_pylist():
                try:
                    rows.append(parse(r or ""))
                    bad.append(False)
                except Malformed:
                    rows.append({})
                    bad.append(True)
            new = [pa.array([x.get(n) for x in rows], k) for n, k in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new, pa.array(bad, pa.bool_())], names=[*batch.schema.names, *names, "malformed"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in raw.schema.fields)
    return raw.mapInArrow(run, f"{own}, {PAYLOAD}, malformed boolean")
