"""Whole operations over a corpus of files (rel_path, content): search report, get, status."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.identity import DEFAULT, Formats
from strandline.sources import corpus, thesaurus
from strandline.sources.folders import checkpointed

from . import projection, retrieval, verify
from .store import Store, freshness

ID, REVISION = re.compile(r"aj1-[0-9a-f]{32}"), re.compile(r"(sha256:)?[0-9a-f]{64}")


def indexed(files: DataFrame, formats: Formats = DEFAULT) -> DataFrame:
    """Records that verify, one of each id: what a projection holds."""
    good = verify.verified(files, formats).filter("verify_status = 'ok'")
    return projection.first_copies(good)


@dataclass
class SearchReport:
    outcome: str
    query_terms: list = field(default_factory=list)
    alias_terms: list = field(default_factory=list)
    folded_terms: list = field(default_factory=list)
    total: int = 0
    best_score: float = 0.0
    next_cursor: str | None = None
    detail: str | None = None
    edited_excluded: int = 0
    hits: list = field(default_factory=list)
    query: str = ""
    #: What the projection holds, where one was searched: records that searches see, and files that were left out.
    index: dict | None = None
    #: Which world, scope and lanes were searched, and with which thesaurus.
    identities: dict | None = None


def search(records: DataFrame | Store, query: str, now_ms: int, world: str = "main", scope: str | None = None, lanes=retrieval.DEFAULT_LANES, aliases=None, limit: int = 10, cursor: str | None = None, knobs: retrieval.Knobs = retrieval.Knobs(), stale: bool = False, sources=None) -> SearchReport:
    """A page of hits with snippets, and what was searched for, in a stored projection or in bare records.

    A cursor holds for the query, world, scope, lanes and thesaurus that made it; another one is
    malformed. No hit is no_match, or index_stale where ``stale`` says that nothing is indexed yet. With
    ``sources`` (``corpus.hashes_at``, ``store.hashes_of``) a stored projection's candidates are held against
    their files as they are now; what was edited since the last sync is left out and counted.
    """
    if isinstance(records, Store):
        found = records.search(query, world, now_ms, scope, lanes, aliases, knobs, sources=sources)
    else:
        found = retrieval.search(records, projection.body_lines(records), query, world, now_ms, scope, lanes, aliases, knobs)
    shown = {"world": world, "scope": scope, "lanes": list(lanes), "thesaurus": thesaurus.digest(aliases or {}), "scorer": retrieval.SCORER}
    index = {"indexed": records.snapshot["episodes"], "excluded": records.snapshot["skipped"] + records.snapshot["duplicates"]} if isinstance(records, Store) and records.snapshot else None
    if found is None:
        return SearchReport("no_match", query=query, index=index, identities=shown)
    out = SearchReport("match", found.plan.base, found.plan.alias_terms, found.plan.folded_terms, detail=found.detail, query=query, index=index, identities=shown)
    out.edited_excluded = found.edited.count() if found.edited is not None else 0
    totals = found.hits.agg(F.count("*"), F.max("score")).first()
    out.total, out.best_score = totals[0], totals[1] or 0.0
    guard = retrieval.guard(query, world, scope or "", lanes, thesaurus.digest(aliases or {}))
    try:
        offset = retrieval.cursor_offset(cursor, guard) if cursor is not None else 0
    except ValueError:
        return SearchReport("malformed", out.query_terms, out.alias_terms, out.folded_terms, out.total, out.best_score, detail="cursor does not match this query", query=query, index=index, identities=shown)
    if not out.total:
        out.outcome = "index_stale" if stale else "no_match"
        return out
    limit = max(min(limit or retrieval.DEFAULT_RESULTS, retrieval.MAX_RESULTS), 1)
    page = checkpointed(retrieval.page(found.hits, found.plan, limit, offset, knobs.confidence_floor).drop("content"))
    rows = records.with_snippets(page, knobs.context_window) if isinstance(records, Store) else retrieval.with_snippets(page.drop("body_line"), records, knobs.context_window)
    rows = rows.orderBy("rank").collect()
    keep = ("episode_id", "rel_path", "scope", "lane", "event_time_ms", "line_no", "snippet", "snippet_start", "snippet_end", "matched_terms", "score", "confidence")
    out.hits = [{k: r[k] for k in keep} | ({"revision": "sha256:" + r["recorded_digest"]} if "recorded_digest" in r else {}) for r in rows]
    if offset + limit < out.total:
        out.next_cursor = retrieval.cursor(offset + limit, guard)
    return out


@dataclass
class GetReport:
    outcome: str
    detail: str | None = None
    revision: str = ""
    path: str = ""
    line_start: int = 0
    line_end: int = 0
    content: str = ""


def get(files: DataFrame, episode_id: str, revision: str, first: int = 0, last: int = 0, path: str | None = None, world: str | None = None, scope: str | None = None, formats: Formats = DEFAULT) -> GetReport:
    """A bounded span of one record, if it still is the revision that was asked for.

    ``path`` is a hint; where it leads nowhere, the record is looked up by its id.
    """
    if not ID.fullmatch(episode_id):
        return GetReport("malformed", "episode_id is ill-formed")
    if not REVISION.fullmatch(revision):
        return GetReport("malformed", "revision is ill-formed")
    if first and last and last < first:
        return GetReport("malformed", "the last line precedes the first")
    hinted = files.filter(F.col("rel_path") == path) if path is not None else files.limit(0)
    row = verify.verified(hinted, formats).first()
    if row is None:
        # The id stands in the record's name and header, so few files are parsed in full.
        named = files.filter(F.contains("rel_path", F.lit(episode_id)) | F.contains("content", F.lit(f"episode_id: {episode_id}\n")))
        row = verify.verified(named, formats).filter(F.col("episode_id") == episode_id).orderBy(F.split("rel_path", "/")).first()
    if row is None:
        return GetReport("gone", "no file has this record")
    if not row["parses"]:
        return GetReport("gone", "the file is no record any more")
    if row["episode_id"] != episode_id:
        return GetReport("gone", "the file holds another record")
    if world is not None and row["world"] != world or scope is not None and row["scope"] != scope:
        return GetReport("gone", "the record is outside the world or scope")
    out = GetReport("stale_revision", "the record was edited and not attested again", path=row["rel_path"])
    if row["verify_status"] != "ok":
        return out
    out.revision = "sha256:" + row["recorded_digest"]
    if row["recorded_digest"] != revision.removeprefix("sha256:"):
        out.detail = "the record was edited; this is its revision now"
        return out
    begin = max(row["body_line"], first)
    end = min(begin + 399, last or begin + 399)
    kept, size = [], 0
    for no, line in enumerate(row["content"].split("\n")[begin - 1 : max(end, begin - 1)], begin):
        used = size + (len(kept) > 0)  # what stands so far, with the line feed before this line
        if size + len(line.encode()) + 1 > 64 << 10:
            break
        kept.append(line)
        size = used + len(line.encode())
        out.line_start, out.line_end = out.line_start or no, no
    out.outcome, out.detail, out.content = "match", None, "\n".join(kept)
    return out


def status(files: DataFrame, stored: DataFrame | Store, formats: Formats = DEFAULT) -> dict:
    """Files, records that verify, others by what is wrong with them, copies, and whether what is stored still holds.

    ``stored`` is a projection, or the hashes (rel_path, file_hash) that an earlier one noted.
    """
    v = verify.verified(files, formats).select("rel_path", "episode_id", "verify_status")
    ok = F.col("verify_status") == "ok"
    counts = v.agg(
        F.count("*").alias("files"),
        F.count_distinct(F.when(ok, F.col("episode_id"))).alias("episodes"),
        F.count_if(ok).alias("verified"),
        F.count_if(F.col("verify_status") == "malformed").alias("malformed"),
        F.count_if(F.col("verify_status") == "digest_mismatch").alias("mismatched"),
    ).first().asDict()
    hashes = files.select("rel_path", F.sha2(F.col("content").cast("binary"), 256).alias("file_hash"))
    if isinstance(stored, Store):
        fresh = freshness(hashes, stored)["freshness"]
    else:
        fresh = "current" if projection.sync_report(hashes, stored).first()["matches"] else "stale"
    return counts | {"copies": counts["verified"] - counts["episodes"], "freshness": fresh}


def status_at(spark: SparkSession, root: str, store: Store, now_ms: int, formats: Formats = DEFAULT) -> dict:
    """``status`` of a corpus folder. Where the signature says that nothing changed, the projection's own table is counted and no file is opened."""
    if not store.holds(signature_of(spark, root), now_ms):
        return status(records_in(spark, root)[0], store, formats)
    is_ = lambda name: F.count_if(F.col("verify_status") == name)
    ok = F.when(F.col("verify_status") == "ok", F.col("episode_id"))
    counts = store.read("files").agg(F.count("*").alias("files"), F.count_distinct(ok).alias("episodes"), is_("ok").alias("verified"), is_("malformed").alias("malformed"), is_("digest_mismatch").alias("mismatched")).first().asDict()
    return counts | {"copies": counts["verified"] - counts["episodes"], "freshness": "current"}


def records_in(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    """(rel_path, content) of a corpus folder's records, and how many files or folders can't be read."""
    found = corpus.read(spark, root)
    unreadable = corpus.read(spark, root, True).filter("kind <> 'episode'").count()
    return found.filter("kind = 'episode'").select("rel_path", F.col("content").cast("string").alias("content")), unreadable


def sync(files: DataFrame, store: Store, unreadable: int = 0, formats: Formats = DEFAULT, signature: tuple[int, int] | None = None) -> dict:
    """Bring the projection up to date; seven counters."""
    return store.sync(files, unreadable, signature, lambda some: verify.verified(some, formats))


def signature_of(spark: SparkSession, root: str) -> tuple[int, int]:
    """Number of a corpus folder's records and the time of their latest change; no file is read."""
    return tuple(corpus.signature(spark, root).first())


def fresh(spark: SparkSession, root: str, store: Store, now_ms: int) -> str:
    """current or stale: by the signature where that is enough, else by every file's hash."""
    if store.holds(signature_of(spark, root), now_ms):
        return "current"
    files = records_in(spark, root)[0]
    return freshness(files.select("rel_path", F.sha2(F.col("content").cast("binary"), 256).alias("file_hash")), store)["freshness"]


def reseal(files: DataFrame, root: str, store: Store | None = None, preview: bool = False, formats: Formats = DEFAULT) -> dict:
    """Attest again what was edited: scanned, resealed, refused, write_failures, and the paths in walk order.

    Records that verify stay as they are; files that are no records are refused. A preview writes nothing;
    else the projection is brought up to date afterwards.
    """
    if corpus.in_shared_directory(root):
        raise PermissionError(f"others may write where {root} lies")
    seen = checkpointed(verify.reseal_preview(files, formats).withColumn("content", F.when(F.col("action") == "reseal", F.col("content"))))
    counts = {r["action"]: r["count"] for r in seen.groupBy("action").count().collect()}
    todo = seen.filter("action = 'reseal'")
    done = todo.select("rel_path") if preview else corpus.write(todo.select("rel_path", "content", F.lit(True).alias("replace")), root).filter("outcome = 'replaced'")
    paths = [r["rel_path"] for r in done.orderBy(F.split("rel_path", "/")).select("rel_path").collect()]  # the report lists them
    if not preview and store is not None:
        signature = signature_of(files.sparkSession, root)
        sync(records_in(files.sparkSession, root)[0], store, formats=formats, signature=signature)
    return {"scanned": sum(counts.values()), "resealed": len(paths), "refused": counts.get("refuse", 0), "write_failures": counts.get("reseal", 0) - len(paths), "paths": paths}


def as_json(report) -> dict:
    return {k: v for k, v in asdict(report).items() if v is not None}
