"""The owner's configuration: a small JSON file of a closed set of keys, read and rewritten in place."""

from __future__ import annotations

import json
import math
import os
import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

MAX_BYTES = 64 << 10
_WORLD, _SCOPE = re.compile(r"[a-z0-9-]{1,64}"), re.compile(r"(?!\.)[A-Za-z0-9._:+@-]{1,128}")
_TEXT, _WHOLE, _REAL = ("journal_root", "world_root", "default_world", "thesaurus_path"), {"context_window": 32, "max_results": 32, "miss_log_max_bytes": 64}, ("recency_boost", "min_score", "confidence_floor")


class MalformedConfig(ValueError):
    pass


@dataclass(frozen=True)
class Config:
    journal_root: str = ""
    default_world: str = ""
    thesaurus_path: str = ""
    context_window: int = 3
    max_results: int = 10
    recency_boost: float = 1.0
    min_score: float = 0.0
    confidence_floor: float = 3.0
    miss_log: bool = False
    miss_log_max_bytes: int = 1 << 20
    world: str = "main"
    scope: str = "default"


class _Number(str):
    """A number as it was written."""


def _ordered(raw: bytes) -> dict:
    def closed(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise MalformedConfig("duplicate key")
        return dict(pairs)

    try:
        if len(raw) > MAX_BYTES:
            raise MalformedConfig("too large")
        top = json.loads(raw.decode(), object_pairs_hook=closed, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
    except (ValueError, RecursionError) as e:
        raise MalformedConfig(str(e)) from None
    if not isinstance(top, dict):
        raise MalformedConfig("not an object")
    return top


def _refuse(word: str):
    raise MalformedConfig(word)


def _whole(value, bits: int) -> int:
    """A whole number, also as text or with an exponent, if a double holds exactly that value."""
    if not isinstance(value, str):
        raise MalformedConfig("not a number")
    if "." not in value and "e" not in value.lower() and value != "-0":
        if not re.fullmatch("[0-9]+", value) or int(value) >= 1 << bits:
            raise MalformedConfig("not a whole number in range")
        return int(value)
    try:
        exact, near = Decimal(value), float(value)
    except (InvalidOperation, ValueError):
        raise MalformedConfig("not a number") from None
    if not exact.is_finite() or exact != exact.to_integral_value() or exact < 0 or not math.isfinite(near) or Decimal(near) != exact or exact >= 1 << bits:
        raise MalformedConfig("not a whole number in range")
    return int(exact)


def _real(value) -> float:
    try:
        out = float(value) if isinstance(value, str) else math.nan
    except ValueError:
        out = math.nan
    if not math.isfinite(out) or out < 0:
        raise MalformedConfig("not a number of zero or more")
    return out


def parse(raw: bytes) -> Config:
    top = _ordered(raw)
    if set(top) - {*_TEXT, *_WHOLE, *_REAL, "miss_log", "capture"}:
        raise MalformedConfig("unknown key")
    given = {k: v for k, v in top.items() if k not in _TEXT or v is not None}
    if any(isinstance(given.get(k), _Number) or not isinstance(given.get(k, ""), str) for k in _TEXT):
        raise MalformedConfig("not text")
    if "journal_root" in given and given.get("world_root", given["journal_root"]) != given["journal_root"]:
        raise MalformedConfig("two roots")
    root = given.get("journal_root", given.get("world_root"))
    values: dict = {k: _whole(given[k], bits) for k, bits in _WHOLE.items() if k in given} | {k: _real(given[k]) for k in _REAL if k in given}
    if not isinstance(given.get("miss_log", False), bool):
        raise MalformedConfig("miss_log is not a boolean")
    capture = given.get("capture", {})
    if not isinstance(capture, dict) or set(capture) - {"world", "scope"} or any(isinstance(v, _Number) or not isinstance(v, str) for v in capture.values()):
        raise MalformedConfig("capture is not a world and a scope")
    out = Config(root or "", given.get("default_world", ""), given.get("thesaurus_path", ""), miss_log=given.get("miss_log", False), **values, **capture)
    for path in (root, given.get("thesaurus_path")):
        if path is not None and not path.startswith("/"):
            raise MalformedConfig("not an absolute path")
    if "default_world" in given and not _WORLD.fullmatch(given["default_world"]):
        raise MalformedConfig("default_world")
    if not 1 <= out.context_window <= 10 or not out.max_results or not _WORLD.fullmatch(out.world) or not _SCOPE.fullmatch(out.scope):
        raise MalformedConfig("a value is out of range")
    return out


def load(path: str | None) -> Config:
    """The owner's configuration; the defaults where there is no file."""
    if path is None or not os.path.exists(path):
        return Config()
    with open(path, "rb") as f:
        return parse(f.read(MAX_BYTES + 1))


def _shown(value, depth: int = 0) -> str:
    """Two blanks a level; numbers in plain decimal notation; only what JSON demands is escaped."""
    pad = "  " * (depth + 1)
    if isinstance(value, _Number):
        if "." not in value and "e" not in value.lower() and value != "-0":
            return str(value)
        near = float(value)
        return value if not math.isfinite(near) else format(Decimal(repr(near)).normalize() if near else Decimal(repr(near)), "f").removesuffix(".0")
    if isinstance(value, dict):
        inner = [f"{pad}{json.dumps(k, ensure_ascii=False)}: {_shown(v, depth + 1)}" for k, v in value.items()]
        return "{\n" + ",\n".join(inner) + "\n" + "  " * depth + "}" if inner else "{}"
    if isinstance(value, list):
        inner = [pad + _shown(v, depth + 1) for v in value]
        return "[\n" + ",\n".join(inner) + "\n" + "  " * depth + "]" if inner else "[]"
    return json.dumps(value, ensure_ascii=False)


def with_capture(raw: bytes, world: str, scope: str) -> str:
    """The file with new capture defaults; all else stays, but for an old name of the root and a world that follows."""
    if not _WORLD.fullmatch(world) or not _SCOPE.fullmatch(scope):
        raise MalformedConfig("world or scope")
    top = _ordered(raw)
    if "world_root" in top:
        old = top.pop("world_root")
        top.setdefault("journal_root", old)
    before = top.get("capture")
    was = before.get("world", "main") if isinstance(before, dict) else "main"
    top["capture"] = {"world": world, "scope": scope}
    if "default_world" in top and world != was:
        top["default_world"] = world
    out = _shown(top) + "\n"
    parse(out.encode())
    return out


def save_capture(path: str, world: str, scope: str) -> None:
    raw = b"{}"
    if os.path.exists(path):
        with open(path, "rb") as f:
            raw = f.read(MAX_BYTES + 1)
    text = with_capture(raw, world, scope)
    with open(os.open(f"{path}.tmp", os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)
