"""Content-derived ids, digests, paths and rendered records."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Formats:
    """Names that go into hashes and files. To work on a corpus that another program began, pass its names."""

    id_tag: str = "episode-id.v1"
    digest_tag: str = "digest.v1"
    id_prefix: str = "aj1-"
    schema: str = "aj-episode.v1"


DEFAULT = Formats()
NUL = "\0"


def episode_id(p: dict[str, Column] | None = None, formats: Formats = DEFAULT) -> Column:
    """Prefix and 32 hex digits of the SHA-256 of the five fields that name a turn."""
    c = lambda n: (p or {}).get(n, F.col(n))
    fields = [F.lit(formats.id_tag), *map(c, ("harness", "session_id", "turn_id", "world", "capture_policy"))]
    return F.concat(F.lit(formats.id_prefix), F.substring(F.sha2(F.concat_ws(NUL, *fields).cast("binary"), 256), 1, 32))


def _frame(value: Column) -> Column:
    return F.concat(F.lit(NUL), F.octet_length(value).cast("string"), F.lit(NUL), value)


def payload_digest(formats: Formats = DEFAULT, **given: Column) -> Column:
    """SHA-256 over all fields that a revision covers, each with its byte length in front."""
    c = lambda n: given.get(n, F.col(n))
    tools = F.coalesce(c("tools"), F.array().cast("array<string>"))
    plain = [c(n) for n in ("world", "scope", "lane", "harness", "session_id", "turn_id")]
    plain += [c("event_time_ms").cast("string"), c("capture_policy"), c("turn_outcome"), c("user_content"), c("assistant_result"), F.size(tools).cast("string")]
    return F.sha2(F.concat(F.lit(formats.digest_tag), *map(_frame, plain), F.array_join(F.transform(tools, _frame), "")).cast("binary"), 256)


def iso_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def layout_path(identity: Column | None = None) -> Column:
    """Where a record lies: parts with default values are left out, days are of the event's UTC time."""
    return F.concat_ws(
        "/",
        F.when(F.col("world") != "main", F.concat(F.lit("worlds/"), F.col("world"))),
        F.when(F.col("scope") != "default", F.concat(F.lit("scopes/"), F.col("scope"))),
        F.when(F.col("lane") != "conversation", F.concat(F.lit("lanes/"), F.col("lane"))),
        F.date_format(F.timestamp_millis("event_time_ms"), "yyyy/MM/dd"),
        F.concat(identity if identity is not None else F.col("episode_id"), F.lit(".md")),
    )


def rendered(formats: Formats = DEFAULT) -> Column:
    """The record as text: header lines, the user's and the assistant's part, and the tools."""
    header = [
        ("schema", F.lit(formats.schema)),
        *((n, F.col(n)) for n in ("episode_id", "world", "scope", "lane", "harness", "adapter_version", "session_id", "turn_id")),
        ("event_time", iso_time(F.col("event_time_ms"))),
        ("event_time_ms", F.col("event_time_ms").cast("string")),
        ("capture_time", iso_time(F.col("capture_time_ms"))),
        ("capture_time_ms", F.col("capture_time_ms").cast("string")),
        *((n, F.col(n)) for n in ("capture_policy", "turn_outcome", "workspace_root", "branch_of", "host")),
        ("payload_digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
    ]
    lines = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{n}: "), v) for n, v in header], F.lit("---"))
    tools = F.coalesce("tools", F.array().cast("array<string>"))
    listed = F.when(F.size(tools) > 0, F.concat(F.lit("\n## Tools\n\n"), F.array_join(F.transform(tools, lambda t: F.concat(F.lit("- "), t, F.lit("\n"))), ""))).otherwise("")
    return F.concat(lines, F.lit("\n\n## User\n\n"), F.col("user_content"), F.lit("\n\n## Assistant\n\n"), F.col("assistant_result"), F.lit("\n"), listed)


#: Hex digits of a root's digest that name its projection.
NAME_DIGITS = 16


def root_digest(root: str) -> str:
    """SHA-256 of a corpus folder's plain absolute path, so that two spellings of it name one projection."""
    return hashlib.sha256(os.path.abspath(os.path.expanduser(root)).encode()).hexdigest()


def projection_path(root: str, environ: Mapping[str, str] = os.environ) -> str:
    """Where the projection of a corpus folder lies if nothing else is said: outside of it, by its digest."""
    state = environ.get("XDG_STATE_HOME", "")
    if not state.startswith("/"):
        state = os.path.join(environ["HOME"], ".local/state")
    return f"{state}/strandline/index-{root_digest(root)[:NAME_DIGITS]}"


def stable_turn_id(session: Column, leaf: Column, branch_length: Column, user: Column, assistant: Column) -> Column:
    """The id of the entry that ends a turn, made a token; where there is none, a digest of what was said and where."""
    text = F.concat_ws(NUL, session, branch_length.cast("string"), user, assistant)
    named = F.concat(F.lit("turn-"), F.substring(F.sha2(text.cast("binary"), 256), 1, 32))
    token = F.substring(F.regexp_replace(leaf, r"[^A-Za-z0-9._:+/@-]", "-"), 1, 128)
    return F.coalesce(F.when(token != "", token), named)
