"""python -m strandline COMMAND ROOT ... : one operation over a corpus folder, as JSON or as text.

Commands: capture, search, get, alias, default, status, catalog, sync, reseal, repair, version.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from datetime import UTC, datetime

VERSION = "2"
EXITS = dict.fromkeys(("match", "no_match", "published", "duplicate", "superseded", "saved"), 0) | {"malformed": 2, "conflict": 3}
USAGE, FAILED = 2, 1


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="strandline", description=__doc__)
    sub = ap.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, root: bool = True, world: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for e in (*(("root",) if root else ()), *positional):
            p.add_argument(e)
        p.add_argument("--text", action="store_true", help="as text instead of JSON")
        if root:
            p.add_argument("--index", help="folder of the projection")
        if world:
            p.add_argument("--world")
            p.add_argument("--scope")
            p.add_argument("--config", help="the owner's configuration")
        return p

    command("capture", "payloads")
    search = command("search", "query", world=True)
    search.add_argument("--limit", type=int)
    search.add_argument("--miss-log", help="log of weak queries, written if the configuration says so")
    search.add_argument("--cursor")
    search.add_argument("--lanes", type=lanes, default=None)
    search.add_argument("--thesaurus")
    search.add_argument("--now-ms", type=int)
    command("get", "episode_id", "revision", world=True).add_argument("--lines")
    command("status")
    command("catalog", world=True)
    command("sync")
    command("reseal").add_argument("--preview", action="store_true")
    repair = command("repair")
    repair.add_argument("--transcripts", required=True, help="log files, as a pattern; a session is named by its file")
    repair.add_argument("--old-policy", required=True)
    repair.add_argument("--new-policy", required=True)
    repair.add_argument("--ledger", required=True, help="folder for the plan and what became of it")
    repair.add_argument("--apply", action="store_true", help="publish and take away; else a plan and its account alone")
    alias = command("alias", "thesaurus", root=False)
    alias.add_argument("action", choices=("list", "add", "remove", "candidates"))
    alias.add_argument("term", nargs="?", help="the term, or the log for candidates")
    alias.add_argument("values", nargs="*")
    alias.add_argument("--limit", type=int, default=20)
    default = command("default", "config", root=False)
    default.add_argument("world_name")
    default.add_argument("scope_name")
    command("version", root=False)
    return ap


def lanes(text: str) -> tuple[str, ...]:
    """Lanes by name, separated by commas, or all."""
    from strandline.functions.contracts import LANES

    named = LANES if text == "all" else tuple(dict.fromkeys(text.split(",")))
    if not set(named) <= set(LANES):
        raise argparse.ArgumentTypeError(f"lanes are {', '.join(LANES)}")
    return named


def without_spark(args) -> dict | None:
    """Commands over small files alone."""
    from strandline.sources import config, thesaurus

    if args.command == "version":
        return {"version": VERSION}
    if args.command == "default":
        config.save_capture(args.config, args.world_name, args.scope_name)
        return {"outcome": "saved", "world": args.world_name, "scope": args.scope_name}
    if args.command == "alias" and args.action != "candidates":
        found = thesaurus.load(args.thesaurus)
        try:
            if args.action == "add":
                found = thesaurus.added(found, args.term or "", args.values)
            elif args.action == "remove":
                for value in args.values or [None]:
                    found = thesaurus.removed(found, args.term or "", value)
        except (ValueError, KeyError) as e:
            return {"outcome": "malformed", "detail": str(e)}
        if args.action != "list":
            thesaurus.save(args.thesaurus, found)
        return {"aliases": found}
    return None


def run(args, spark) -> dict:
    from pyspark.sql import functions as F

    from strandline.functions import contracts, identity
    from strandline.operators import analytics, capture, engine, projection, repair, retrieval, transcripts
    from strandline.operators.reports import lines_of
    from strandline.operators.store import Store
    from strandline.sources import config, corpus, thesaurus

    owner = config.load(getattr(args, "config", None))
    world = getattr(args, "world", None) or owner.default_world or "main"
    now_ms = getattr(args, "now_ms", None) or int(time.time() * 1000)
    if args.command == "alias":
        rows = analytics.top_weak_queries(thesaurus.weak_log(spark, args.term), args.limit).collect()
        return {"candidates": [r.asDict() for r in rows]}
    store = Store(spark, args.index or identity.projection_path(args.root))
    if args.command == "capture":
        os.makedirs(args.root, 0o700, exist_ok=True)
        held, unreadable = engine.records_in(spark, args.root)
        # Files come in the order of their last change, then of their names.
        raw = spark.read.format("binaryFile").load(args.payloads)
        raw = raw.select(F.struct("modificationTime", "path").alias("seq"), F.col("content").cast("string").alias("value"))
        decided, written = capture.capture(contracts.parse_payloads(raw), held, args.root, int(time.time() * 1000))
        counts = {r["outcome"]: r["n"] for r in decided.groupBy("outcome").agg(F.count("*").alias("n")).collect()}
        try:
            signature = engine.signature_of(spark, args.root)
            engine.sync(engine.records_in(spark, args.root)[0], store, unreadable, signature=signature)
            state = "current"
        except Exception as e:  # what was published stands; the next sync makes up for it
            state = f"stale: {str(e).splitlines()[0]}"
        paths = sorted(r["rel_path"] for r in written.filter("outcome <> 'exists'").collect())  # a spool's worth
        alone = next(iter(counts)) if len(counts) == 1 else "match"
        return {"outcome": alone, "outcomes": counts, "written": paths, "index": state}
    if args.command == "search":
        words = args.thesaurus or owner.thesaurus_path
        aliases = thesaurus.load(words) if words else None
        knobs = retrieval.Knobs(owner.context_window, owner.recency_boost, owner.min_score, owner.confidence_floor)
        stale = store.meta() is None
        report = engine.search(store, args.query, now_ms, world, args.scope, args.lanes or retrieval.DEFAULT_LANES, aliases, args.limit or owner.max_results, args.cursor, knobs, stale, corpus.hashes_at(args.root))
        if owner.miss_log and report.outcome in ("match", "no_match") and report.best_score < owner.confidence_floor:
            log = args.miss_log or os.path.join(os.path.dirname(identity.projection_path(args.root)), "weak-queries.jsonl")
            ts = datetime.fromtimestamp(now_ms // 1000, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            thesaurus.log_weak(log, ts, args.query, report.query_terms, report.best_score, report.hits[0]["episode_id"] if report.hits else None, owner.miss_log_max_bytes)
        return report if args.text else engine.as_json(report)
    if args.command == "get":
        try:
            first, last = lines_of(args.lines)
        except ValueError as e:
            return {"outcome": "malformed", "detail": str(e)}
        # The projection says where the record lies; only if it isn't there the whole corpus is looked through.
        row = store.lookup(args.episode_id)
        try:
            content = corpus.contained(args.root, row["rel_path"])[1] if row else None
        except (OSError, ValueError):
            content = None
        if content is None:
            files = engine.records_in(spark, args.root)[0]
        else:
            files = spark.createDataFrame([(row["rel_path"], content.decode("utf-8", "replace"))], "rel_path string, content string")
        report = engine.get(files, args.episode_id, args.revision, first, last, row and row["rel_path"], scope=args.scope)
        return report if args.text else engine.as_json(report)
    if args.command == "catalog":
        rows = projection.catalog(store.read("episodes").select("world", "scope"), world, args.scope or owner.scope).collect()
        return {"pairs": [r.asDict() for r in sorted(rows, key=lambda r: (not r["is_default"], r["world"], r["scope"]))]}
    signature = engine.signature_of(spark, args.root)
    files, unreadable = engine.records_in(spark, args.root)
    if args.command == "sync":
        return engine.sync(files, store, unreadable, signature=signature)
    if args.command == "repair":
        job = repair.Repair(spark, args.root, args.ledger)
        what = files, transcripts.entries(transcripts.logs(spark, args.transcripts)), args.old_policy, args.new_policy, VERSION
        if args.apply:
            return job.run(*what, now_ms, store).first().asDict()
        job.plan(*what)
        return job.account().first().asDict()
    if args.command == "reseal":
        return engine.reseal(files, args.root, store, args.preview)
    return engine.status_at(spark, args.root, store, now_ms)


def main(argv: list[str] | None = None) -> int:
    from strandline.operators import engine, reports

    args = parser().parse_args(argv)
    report = without_spark(args)
    if report is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        try:
            report = run(args, spark)
        except PermissionError as e:
            print(e, file=sys.stderr)
            return FAILED
    if isinstance(report, engine.SearchReport):
        print(reports.search_text(args.query, report))
    elif isinstance(report, engine.GetReport):
        print(reports.get_text(report))
    else:
        print(reports.counts_text(args.command, report) if args.text else json.dumps(report, ensure_ascii=False, default=str))
    outcome = report.get("outcome", "match") if isinstance(report, dict) else report.outcome
    return EXITS.get(outcome, FAILED)


if __name__ == "__main__":
    sys.exit(main())
