"""The thesaurus and the log of weak queries; small driver-side files."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import LOWER, UPPER

MAX_BYTES, MAX_VALUE, MAX_LOG = 256 << 10, 128, 1 << 20
_ASCII = str.maketrans(UPPER, LOWER)


def aliases(raw: bytes) -> dict[str, list[str]]:
    """Keys trimmed and lowered, values in ASCII lower case; equal keys merge. A broken file is an empty one."""
    try:
        pairs = json.loads(raw.decode("utf-8"), object_pairs_hook=lambda p: p)
    except (ValueError, RecursionError):
        return {}
    if len(raw) > MAX_BYTES or not isinstance(pairs, list) or not all(isinstance(p, tuple) for p in pairs):
        return {}
    out: dict[str, list[str]] = {}
    for key, values in pairs:
        if not isinstance(values, list) or any(isinstance(v, tuple) for v in values):
            continue
        name = key.strip().lower()
        found = [v.translate(_ASCII) for v in values if isinstance(v, str) and 0 < len(v.encode()) <= MAX_VALUE]
        if name in out:
            out[name] += [v for i, v in enumerate(found) if v not in out[name] and v not in found[:i]]
        else:
            out[name] = found
    return dict(sorted(out.items()))


def load(path: str) -> dict[str, list[str]]:
    try:
        with open(path, "rb") as f:
            return aliases(f.read(MAX_BYTES + 1))
    except OSError:
        return {}


def digest(found: dict[str, list[str]]) -> str:
    """A digest of the meaning: keys in order, values in order without repeats, lengths in front."""
    framed = lambda s: str(len(s.encode())).encode() + b"\0" + s.encode()
    h = hashlib.sha256()
    for key in sorted(found, key=str.encode):
        h.update(framed(key) + b"".join(b"\0" + framed(v) for v in sorted(set(found[key]), key=str.encode)) + b"\n")
    return h.hexdigest()


def added(found: dict[str, list[str]], term: str, values: list[str]) -> dict[str, list[str]]:
    key = term.strip().lower()
    if not key or not values:
        raise ValueError("an alias needs a term and a value")
    return found | {key: list(dict.fromkeys([*found.get(key, []), *(v.translate(_ASCII) for v in values)]))}


def removed(found: dict[str, list[str]], term: str, value: str | None = None) -> dict[str, list[str]]:
    """Without a whole entry, or without one value; an entry goes with its last value."""
    key = term.strip().lower()
    if key not in found or value is not None and value.translate(_ASCII) not in found[key]:
        raise KeyError(term)
    rest = [] if value is None else [v for v in found[key] if v != value.translate(_ASCII)]
    return {k: (rest if k == key else v) for k, v in found.items() if k != key or rest}


def save(path: str, found: dict[str, list[str]]) -> None:
    """Write the thesaurus whole or not at all; no other user can read it."""
    part = f"{path}.{os.getpid()}.tmp"
    with open(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        json.dump(found, f, ensure_ascii=False, indent=2)
        f.write("\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def log_weak(path: str, ts: str, query: str, terms: list[str], best: float, top: str | None, most: int = MAX_LOG) -> bool:
    """Append one line unless the log is full."""
    line = json.dumps({"ts": ts, "query": query, "terms": terms, "best": best, "top": top}, ensure_ascii=False) + "\n"
    if os.path.exists(path) and os.path.getsize(path) + len(line.encode()) > most:
        return False
    os.makedirs(os.path.dirname(os.path.abspath(path)), 0o700, exist_ok=True)
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_APPEND, 0o600), "a", encoding="utf-8") as f:
        f.write(line)
    return True


def weak_log(spark: SparkSession, path: str) -> DataFrame:
    """The log's rows; lines that aren't objects of the shape are left out."""
    schema = "ts string, query string, terms array<string>, best double, top string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter(F.col("query").isNotNull())
