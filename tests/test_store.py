"""The stored projection, judged queries, capture into a corpus, and the command line."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from strandline import __main__ as cli
from strandline.functions import identity, text
from strandline.operators import analytics, assemble, capture, engine, evaluation, projection, prompts, reports, retrieval, sessions, store, transcripts, verify
from strandline.sources import corpus
from tests.test_records import BASE, parsed, stored

NOW, DAY = 1_700_000_000_000, 86_400_000


def turns(n=12):
    rng = random.Random(3)
    words = "fox foxes den river wombat license rights version the of burrow".split()
    return [BASE | {"turn_id": str(i), "user_content": " ".join(rng.choice(words) for _ in range(8)), "event_time_ms": NOW - i * 9 * DAY, "world": "w" if i % 4 == 0 else "main", "lane": "evaluation" if i % 5 == 0 else "conversation"} for i in range(n)]


@pytest.fixture(scope="module")
def files(spark):
    return stored(spark, turns()).select("rel_path", "content").cache()


def edited(files, path):
    return files.withColumn("content", F.when(F.col("rel_path") == path, F.regexp_replace("content", "a first answer", "another one")).otherwise(F.col("content")))


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def files_read(df):
    return len(df.inputFiles())


def fresh(records):
    good = projection.first_copies(records.filter("parses"))
    return rows(projection.postings(good)), rows(projection.term_stats_of(good))


def kept(found):
    return rows(found.read("postings")), rows(found.statistics())


def test_sync_equals_building_anew(spark, files, tmp_path):
    found = store.Store(spark, str(tmp_path / "index"))
    assert found.meta() is None and found.statistics().count() == 0
    paths = sorted(r.rel_path for r in files.collect())
    report = engine.sync(files, found)
    assert report == {"indexed": 12, "unchanged": 0, "removed": 0, "skipped_malformed": 0, "duplicate_ids": 0, "digest_mismatch": 0, "unreadable": 0}
    assert kept(found) == fresh(verify.verified(files))
    assert engine.sync(files, found)["unchanged"] == 12 and engine.status(files, found)["freshness"] == "current"
    # One is edited, one moves, two go, one copy and one broken file come.
    now = edited(files, paths[0]).filter(~F.col("rel_path").isin(paths[1:3]))
    now = now.withColumn("rel_path", F.when(F.col("rel_path") == paths[3], F.lit("moved.md")).otherwise(F.col("rel_path")))
    now = now.unionByName(files.filter(F.col("rel_path") == paths[4]).withColumn("rel_path", F.lit("zz/copy.md"))).unionByName(spark.createDataFrame([("bad.md", "x")], "rel_path string, content string"))
    assert engine.status(now, found)["freshness"] == "stale"
    report = engine.sync(now, found, unreadable=0)
    assert report == {"indexed": 2, "unchanged": 8, "removed": 2, "skipped_malformed": 1, "duplicate_ids": 1, "digest_mismatch": 1, "unreadable": 0}
    assert kept(found) == fresh(verify.verified(now)) and engine.status(now, found)["freshness"] == "current"
    assert engine.sync(now.limit(0), found)["removed"] == 10 and kept(found) == ([], []) and found.read("episodes").count() == 0


def test_search_in_store_equals_scan(spark, files, tmp_path):
    found = store.Store(spark, str(tmp_path / "index"))
    engine.sync(files, found)
    records = engine.indexed(files)
    for query, world, lanes in (("fox den", "main", retrieval.DEFAULT_LANES), ("licenses rights", "w", retrieval.DEFAULT_LANES), ("wombat", "main", ("evaluation",)), ("zebra", "main", retrieval.DEFAULT_LANES)):
        a, b = (engine.search(x, query, NOW, world, lanes=lanes, limit=5) for x in (found, records))
        assert engine.as_json(a) == engine.as_json(b) | {"index": {"indexed": 12, "excluded": 0}}
    first = engine.search(found, "fox den", NOW, limit=1)
    assert engine.search(found, "fox den", NOW, limit=1, cursor=first.next_cursor).hits[0] == engine.search(records, "fox den", NOW, limit=2).hits[1]
    lines, _, more = found.candidates("main", ["fox"])
    plan = lines._jdf.queryExecution().explainString(lines.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scans = [x for x in plan.split("\n\n") if x.lstrip().startswith("(") and "Scan parquet" in x.strip().split("\n")[0]]
    assert not more and len(scans) >= 3 and any("PushedFilters" in x and "term" in x.split("PushedFilters")[1] for x in scans)
    assert files_read(found._scan("postings", store.parts_of(["fox"], 8))) == 1 < files_read(found._scan("postings"))
    # What was edited is left out, and counted.
    hit = first.hits[0]
    engine.sync(edited(files, hit["rel_path"]), found)
    after = engine.search(found, "fox den", NOW, limit=50)
    assert after.edited_excluded == 1 and hit["episode_id"] not in {h["episode_id"] for h in after.hits}
    assert found.lookup(hit["episode_id"])["verify_status"] == "digest_mismatch" and found.lookup("x") is None


def test_store_of_another_version_is_built_anew(spark, files, tmp_path, monkeypatch):
    found = store.Store(spark, str(tmp_path / "index"))
    engine.sync(files, found)
    monkeypatch.setattr(store, "VERSION", store.VERSION + 1)
    again = store.Store(spark, str(tmp_path / "index"))
    assert again.meta() is None and again.read("episodes").count() == 0
    assert engine.sync(files, again)["indexed"] == 12


def test_tools_and_text(spark, files, tmp_path):
    found = store.Store(spark, str(tmp_path / "index"))
    engine.sync(files, found)
    tools = reports.Tools(found, files, NOW)
    said = tools.memory_search("fox den", 2)
    assert "[reference 1]" in said and "[reference 2]" in said
    assert "a first answer" in tools.memory_get(1) and "malformed" in tools.memory_get(1, "9-3") and "gone" in tools.memory_get(7)
    report = engine.search(found, "fox den", NOW, aliases={"den": ["burrow"]}, limit=1)
    assert "burrow" in reports.search_text("fox den", report) and "--cursor" in reports.search_text("fox den", report)
    assert "nothing matches" in reports.search_text("zebra", engine.search(found, "zebra", NOW))
    few = reports.References(2)
    assert [few.remember({"episode_id": str(i), "rel_path": "p", "scope": "s"}, "main") for i in range(3)] == [1, 2, 3] and list(few.known) == [2, 3]
    assert reports.lines_of("3-") == (3, 0) and reports.lines_of("4") == (4, 4) and reports.lines_of("") == (0, 0)


def test_many_queries_equal_single_ones(spark, files):
    records = engine.indexed(files)
    asked = [("a", "fox den"), ("b", "licenses rights"), ("c", "zebra"), ("d", "the of"), ("e", "wombat river burrow")]
    queries = spark.createDataFrame([(i, "known_item", q) for i, q in asked], "id string, type string, query string")
    n = records.filter("world = 'main' AND lane <> 'evaluation'").count()
    hits = evaluation.rank_many(queries, projection.postings(records), projection.body_lines(records), n, "main", NOW)
    got = {i: [(r.rank, r.episode_id, r.line_no, round(r.score, 9)) for r in hits.filter(F.col("id") == i).orderBy("rank").collect()] for i, _ in asked}
    for i, q in asked:
        found = engine.search(records, q, NOW)
        assert got[i] == [(k, h["episode_id"], h["line_no"], round(h["score"], 9)) for k, h in enumerate(found.hits, 1)]
    second = got["a"][1][1]
    each = evaluation.per_query(queries, hits, spark.createDataFrame([("a", second), ("c", second)], "id string, episode_id string"))
    m = evaluation.metrics(each).first()
    assert m.queries == 5 and m.mrr_at_10 == pytest.approx(0.1) and (m.recall_at_1, m.recall_at_10, m.negatives) == (0.0, pytest.approx(0.2), 0)


def test_capture_knows_the_corpus(spark, tmp_path):
    root = str(tmp_path / "journal")
    os.mkdir(root, 0o700)
    kinds = {k: BASE | {"turn_id": k} for k in ("same", "longer", "other", "edited", "moved")}

    def held():
        return engine.records_in(spark, root)[0]

    def take(payloads):
        decided, written = capture.capture(parsed(spark, payloads), held(), root, NOW)
        return [r.outcome for r in decided.orderBy("seq").collect()], sorted(r.outcome for r in written.collect())

    assert take(list(kinds.values())) == (["published"] * 5, ["published"] * 5)
    paths = {r.turn_id: r.rel_path for r in verify.verified(held()).collect()}
    for path, change in ((paths["edited"], lambda t: t.replace("first", "second")), (paths["moved"], None)):
        full = f"{root}/{path}"
        if change:
            with open(full) as f:
                content = change(f.read())
            with open(full, "w") as f:
                f.write(content)
        else:
            os.rename(full, f"{root}/{os.path.basename(path)}")
    longer = kinds["longer"] | {"assistant_result": "a first answer, and more"}
    again = [kinds["same"], longer, kinds["other"] | {"assistant_result": "no"}, kinds["edited"] | {"assistant_result": "a first answer!"}, kinds["edited"], kinds["moved"] | {"assistant_result": "a first answer!"}, kinds["moved"], BASE | {"turn_id": "new"}]
    assert take(again) == (["duplicate", "superseded", "conflict", "conflict", "duplicate", "conflict", "duplicate", "published"], ["published", "replaced"])
    with open(f"{root}/{paths['longer']}") as f:
        assert "and more" in f.read()
    assert take([longer, BASE | {"turn_id": "x", "lane": "no"}]) == (["duplicate", "malformed"], [])
    os.chmod(tmp_path, 0o777)
    with pytest.raises(PermissionError):
        take([longer])


def test_contained_reads(tmp_path):
    root = tmp_path / "journal"
    (root / "a").mkdir(parents=True)
    (root / "a" / "aj1-x.md").write_text("x")
    os.symlink(root / "a", root / "link")
    os.mkfifo(root / "a" / "aj1-pipe.md")
    assert corpus.contained(str(root), "a/aj1-x.md")[1] == b"x"
    for bad in ("link/aj1-x.md", "a/aj1-pipe.md", "a/none.md", "../x", "a//x"):
        with pytest.raises((OSError, ValueError)):
            corpus.contained(str(root), bad)
    with pytest.raises(ValueError):
        corpus.contained(str(root), "a/aj1-x.md", most=0)
    assert [p for _, p in corpus.walk(str(root))] == ["a/aj1-x.md"]
    with pytest.raises(OSError):
        corpus.publish(str(root), "link/aj1-y.md", b"y")
    assert corpus.publish(str(root), "b/aj1-y.md", b"y") == "published" and corpus.publish(str(root), "b/aj1-y.md", b"y") == "exists"
    assert corpus.publish(str(root), "b/aj1-y.md", b"y", began=0.0) == "published" and corpus.publish(str(root), "b/aj1-y.md", b"z", True) == "replaced"
    assert os.listdir(root / "b") == ["aj1-y.md"] and (root / "b" / "aj1-y.md").stat().st_mode & 0o777 == 0o600


def test_reseal_writes(spark, tmp_path):
    root, index = str(tmp_path / "journal"), str(tmp_path / "index")
    os.mkdir(root, 0o700)
    corpus.write(stored(spark, turns(4)), root)
    files, _ = engine.records_in(spark, root)
    paths = sorted(r.rel_path for r in files.collect())
    found = store.Store(spark, index)
    engine.sync(files, found)
    for p in paths[:2]:
        with open(f"{root}/{p}") as f:
            content = f.read().replace("a first answer", "edited by hand")
        with open(f"{root}/{p}", "w") as f:
            f.write(content)
    with open(f"{root}/aj1-bad.md", "w") as f:
        f.write("x")
    seen = engine.reseal(engine.records_in(spark, root)[0], root, found, preview=True)
    assert (seen["scanned"], seen["resealed"], seen["refused"], seen["write_failures"]) == (5, 2, 1, 0) and set(seen["paths"]) == set(paths[:2])
    assert engine.status(engine.records_in(spark, root)[0], found)["mismatched"] == 2
    assert engine.reseal(engine.records_in(spark, root)[0], root, found)["resealed"] == 2
    status = engine.status(engine.records_in(spark, root)[0], found)
    assert (status["mismatched"], status["malformed"], status["freshness"]) == (0, 1, "current")


def test_stream_keeps_order_in_large_groups(spark, tmp_path):
    """20,000 deliveries of one turn in one micro-batch, dealt to many files in any order."""
    from strandline.streaming import capture_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    result = F.concat(F.lit("a"), F.expr("repeat('b', cast(seq / 4000 as int))"))
    many = parsed(spark, [BASE]).drop("seq", "value").crossJoin(spark.range(20_000).select(F.col("id").alias("seq"))).withColumn("assistant_result", result)
    ready = capture.prepared(many).orderBy(F.xxhash64("seq"))
    ready.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    run = capture_stream.outcomes(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.seq: r.outcome for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 20_000
    assert all(o == ("published" if s == 0 else "superseded" if s % 4000 == 0 else "duplicate") for s, o in got.items())


def test_prompts_wait_for_replies(spark, tmp_path):
    hour = 3_600_000
    rows = [
        ("s", "1", "prompt", 0, "first try"), ("s", "1", "prompt", 1, "what is it"), ("s", "1", "stop", 2, "  "), ("s", "1", "stop", 3, "that"), ("s", "1", "stop", 4, "again"),
        ("s", "2", "prompt", 0, "too old"), ("s", "2", "stop", 49 * hour, "late"), ("s", "3", "prompt", 5, " a "), ("s", "3", "stop", 6, "x"), ("s", "4", "stop", 1, "x"), ("s", "4", "prompt", 2, "open one"), ("s", "5", "prompt", 0, None),
    ]
    events = spark.createDataFrame(rows, "session_id string, turn_id string, kind string, time_ms long, text string")
    want = [("s", "1", 1, "what is it", "that")]
    assert [tuple(r) for r in prompts.paired(events).collect()] == want
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
        run = prompts.paired_stream(stream, forget=False).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == want


def test_scalars(spark, tmp_path):
    df = spark.createDataFrame([("é" * 10, "box.local", None, 2), ("short", " a b.c", "leaf id", 3), (None, "", "", 4)], "t string, h string, leaf string, n int")
    out = df.select(text.truncated(F.col("t"), 9), text.host_label(F.col("h")), identity.stable_turn_id(F.lit("s"), F.col("leaf"), F.col("n"), F.lit("u"), F.lit("a"))).collect()
    assert out[0][0] == "é" * 4 + text.CUT_MARK and out[1][0] == "short" and out[2][0] is None
    assert [r[1] for r in out] == ["box", None, None] and out[1][2] == "leaf-id" and out[0][2].startswith("turn-") and len(out[2][2]) == 37
    assert identity.root_digest("/a//b/") == identity.root_digest("/a/b") and identity.projection_path("/a", {"HOME": "/h"}).startswith("/h/.local/state/")
    assert not corpus.in_shared_directory(str(tmp_path / "x" / "y"))


def test_top_lists(spark):
    log = spark.createDataFrame([("b", ["x"]), ("a", ["y"]), ("B ", ["z"]), ("c", [])], "query string, terms array<string>")
    assert [(r.query, r["count"]) for r in analytics.top_weak_queries(log, 2).collect()] == [("b", 2), ("a", 1)]


def test_commands(spark, tmp_path, capsys):
    root, spool, index = (str(tmp_path / n) for n in ("journal", "spool", "index"))
    os.makedirs(spool)

    def run(*args):
        code = cli.main(list(args))
        return code, json.loads(capsys.readouterr().out.splitlines()[-1])

    def put(name, payload, at):
        with open(f"{spool}/{name}", "w") as f:
            json.dump(payload, f)
        os.utime(f"{spool}/{name}", (at, at))

    # The later file sorts first by name: the order is that of the times.
    put("a.json", BASE | {"assistant_result": "a first answer, and more"}, 2_000_000)
    put("b.json", BASE, 1_000_000)
    code, made = run("capture", root, spool, "--index", index)
    assert code == 0 and made["outcomes"] == {"published": 1, "superseded": 1} and made["index"] == "current"
    assert run("capture", root, spool, "--index", index)[1]["outcomes"] == {"conflict": 1, "duplicate": 1}
    assert run("status", root, "--index", index)[1]["freshness"] == "current"
    code, found = run("search", root, "hello", "--index", index, "--lanes", "all")
    assert code == 0 and found["total"] == 1
    hit = found["hits"][0]
    assert run("get", root, hit["episode_id"], hit["revision"], "--index", index)[0] == 0
    assert run("get", root, hit["episode_id"], hit["revision"], "--index", index, "--lines", "x")[0] == 2
    assert run("catalog", root, "--index", index)[1]["pairs"][0] == {"world": "main", "scope": "default", "is_default": True}
    with open(f"{root}/{hit['rel_path']}") as f:
        content = f.read().replace("hello there", "hello here")
    with open(f"{root}/{hit['rel_path']}", "w") as f:
        f.write(content)
    assert run("status", root, "--index", index)[1]["freshness"] == "stale"
    assert run("sync", root, "--index", index)[1]["digest_mismatch"] == 1
    assert run("reseal", root, "--index", index, "--preview")[1]["resealed"] == 1 and run("reseal", root, "--index", index)[1]["resealed"] == 1
    assert run("search", root, "hello", "--index", index)[1]["total"] == 1
    words = str(tmp_path / "words.json")
    assert run("alias", words, "add", "greeting", "hello")[1]["aliases"] == {"greeting": ["hello"]}
    assert run("search", root, "greeting", "--index", index, "--thesaurus", words)[1]["alias_terms"] == ["hello"]
    assert run("alias", words, "remove", "greeting")[1]["aliases"] == {} and run("alias", words, "remove", "greeting")[0] == 2
    assert run("default", str(tmp_path / "c.json"), "team", "default")[0] == 0 and run("version")[1]["version"]
    assert cli.main(["search", root, "hello", "--index", index, "--text"]) == 0 and "1 of 1" in capsys.readouterr().out
    os.chmod(tmp_path, 0o777)
    assert cli.main(["reseal", root, "--index", index]) == 1


def test_signature_spares_reading(spark, tmp_path):
    root = str(tmp_path / "journal")
    os.mkdir(root, 0o700)
    corpus.write(stored(spark, turns(3)), root)
    found, now = store.Store(spark, str(tmp_path / "index")), 10**15
    signature = engine.signature_of(spark, root)
    engine.sync(engine.records_in(spark, root)[0], found, signature=signature)
    assert found.holds(signature, now) and not found.holds(signature, signature[1]) and not found.holds((4, signature[1]), now)
    assert engine.fresh(spark, root, found, now) == engine.fresh(spark, root, found, 0) == "current"
    path = next(p for _, p in corpus.walk(root))
    os.utime(f"{root}/{path}", (2_000_000_000, 2_000_000_000))
    assert not found.holds(engine.signature_of(spark, root), now) and engine.fresh(spark, root, found, now) == "current"
    os.unlink(f"{root}/{path}")
    assert engine.fresh(spark, root, found, now) == "stale"


def test_payloads_of_turns(spark):
    rows = [("s", "1", "a question", "an answer", 5, "/work", "box.local"), ("s", "2", " a ", "x", 5, None, None), ("s", "3", "what", " ", 5, None, None), ("s", "4", "long " * 400_000, "yes", None, "bad\npath", "")]
    turns_ = spark.createDataFrame(rows, "session_id string, turn_id string, user_content string, assistant_result string, event_time_ms long, cwd string, host string")
    made = assemble.payloads(turns_, "h", "1", "every-turn", NOW)
    got = {r.turn_id: r for r in capture.prepared(made).collect()}
    assert set(got) == {"1", "4"} and all(r.error is None for r in got.values())
    assert (got["1"].workspace_root, got["1"].host, got["1"].event_time_ms) == ("/work", "box", 5)
    assert got["4"].workspace_root is None and got["4"].event_time_ms == NOW and got["4"].user_content.endswith(text.CUT_MARK)


def test_import_account(spark):
    rows = [("a", 0, ""), ("a", 1, '{"type": "session"}'), ("b", 0, '{"type": "session", "parentSession": null}'), ("c", 0, '{"type": "message"}'), ("d", 0, " "), ("e", 0, "{")]
    reasons = sessions.skip_reasons(spark.createDataFrame(rows, "session string, line_no long, value string"))
    assert {r.session: r.skip_reason for r in reasons.collect()} == {"a": None, "b": "subagent", "c": "no_header", "d": "empty", "e": "no_header"}
    took = spark.createDataFrame([("published",), ("superseded",), ("duplicate",), ("malformed",)], "outcome string")
    skipped = spark.createDataFrame([(True,), (False,)], "skip boolean")
    assert assemble.import_counts(reasons, skipped, took).first().asDict() == {"files": 1, "skipped_files": 4, "skipped_turns": 1, "published": 2, "existing": 1, "failed": 1}


def test_digest_probe(spark, files):
    probed = files.select(verify.digest_probe(F.col("content")).alias("d"), "rel_path", "content")
    good = verify.verified(files).select("rel_path", "recorded_digest")
    assert probed.join(good, "rel_path").filter("d <> recorded_digest").count() == 0
    odd = spark.createDataFrame([("x",), ("---\na: b\n---\npayload_digest: sha256:" + "0" * 64,)], "content string")
    assert [r[0] for r in odd.select(verify.digest_probe(F.col("content"))).collect()] == [None, None]


def test_turns_come_to_rest(spark):
    rows = [("s", "a", t, p) for t, p in ((0, None), (50, "x"), (100, "x"), (150, "xy"), (250, "xy"), (300, "xy"), (400, "xy"), (900, "z"))]
    rows += [("s", "b", t, p) for t, p in ((0, "x"), (100, None), (200, "x"), (340, "x"))] + [("s", "c", t, "late") for t in (0, 2100)]
    looks = spark.createDataFrame(rows, "session_id string, turn_id string, seen_ms long, payload string")
    assert [tuple(r) for r in prompts.settled(looks).collect()] == [("s", "a", 300, "xy")]
    assert {r.turn_id for r in prompts.settled(looks, look_ms=5000).collect()} == {"a", "c"}


def test_completed_turns_stated_again(spark):
    """What a transcript's turns are, by a plain loop over its entries."""
    rng = random.Random(8)

    def line(kind):
        text = rng.choice(["ask me", "hi", "say it", "<system-reminder>x</system-reminder> go on", "<command-name>/do</command-name><command-args>it now</command-args>"])
        if kind == "user":
            return {"type": "user", "uuid": str(rng.random()), "message": {"content": text}}
        if kind == "result":
            return {"type": "user", "message": {"content": [{"type": "tool_result"}]}}
        blocks = [{"type": "text", "text": rng.choice(["done", "and so", " "])}] + [{"type": "tool_use", "name": rng.choice(["read", "write", "no good"])}] * rng.randint(0, 2)
        return {"type": "assistant", "isSidechain": rng.random() < 0.2, "message": {"content": blocks, "stop_reason": rng.choice(["end_turn", "tool_use"])}}

    logs = {f"s{k}": [line(rng.choice(["user", "result", "assistant", "assistant"])) for _ in range(rng.randint(0, 14))] for k in range(25)}
    want = []
    for name, log in logs.items():
        turns_ = []
        for o in log:
            e = transcripts.entry(json.dumps(o))
            if e["kind"] in ("owner", "envelope"):
                turns_.append({"user": e["text"], "said": [], "tools": [], "id": e["uuid"]})
            elif e["kind"] == "assistant" and turns_:
                turns_[-1]["said"] += [e["text"]] * e["terminal"]
                turns_[-1]["tools"] = list(dict.fromkeys([*turns_[-1]["tools"], *(t for t in e["tools"] if " " not in t)]))
        want += [(name, t["user"], "\n\n".join(t["said"]), tuple(t["tools"]), t["id"]) for t in turns_ if len(t["user"]) >= 3 and t["said"]]
    rows = [(name, i, json.dumps(o)) for name, log in logs.items() for i, o in enumerate(log)]
    found = transcripts.completed_turns(transcripts.entries(spark.createDataFrame(rows, "session string, line_no long, value string")))
    got = [(r.session, r.user_content, r.assistant_result, tuple(r.tools), r.turn_id) for r in found.collect()]
    assert sorted(got) == sorted(want) and len(want) > 10


def test_terms_of_emptied_parts_go(spark, tmp_path):
    """A record that has no index term left takes its postings, frequencies, vocabulary and trigrams with it."""
    found = store.Store(spark, str(tmp_path / "index"))
    base = spark.createDataFrame([("a/1.md", "license rights fox"), ("a/2.md", "rights")], "rel_path string, content string")
    extra = {"world": "main", "scope": "s", "lane": "conversation", "event_time_ms": 5, "body_line": 1, "parses": True, "verify_status": "ok"}
    whole = lambda df: df.withColumns({k: F.lit(v) for k, v in extra.items()} | {"episode_id": F.col("rel_path")})
    found.sync(whole(base))
    assert {r.term for r in found.vocabulary("main").collect()} == {"license", "rights", "fox"}
    report = found.sync(whole(base.withColumn("content", F.when(F.col("rel_path") == "a/1.md", "the").otherwise(F.col("content")))))
    assert (report["indexed"], report["unchanged"]) == (1, 1)
    assert rows(found.read("postings")) == [("a/2.md", "conversation", 1, "rights", "main")]
    assert rows(found.statistics()) == [(1, 0, "rights", "main")] and {r.term for r in found.read("trigrams").collect()} == {"rights"}
    assert found.terms_with("main", ["licen"]).collect() == [] and found.search("license", "main", NOW).hits.count() == 0
    found.sync(whole(base.limit(0)))
    assert found.read("postings").count() == found.statistics().count() == found.read("trigrams").count() == found.read("files").count() == 0


def test_readers_keep_their_snapshot(spark, files, tmp_path):
    root = str(tmp_path / "index")
    engine.sync(files, store.Store(spark, root))
    reader = store.Store(spark, root)
    before = engine.as_json(engine.search(reader, "fox den", NOW, limit=50))
    hit = before["hits"][0]
    writer = store.Store(spark, root)
    engine.sync(edited(files, hit["rel_path"]).filter(F.col("rel_path") != before["hits"][-1]["rel_path"]), writer)
    assert engine.as_json(engine.search(reader, "fox den", NOW, limit=50)) == before
    after = engine.search(writer, "fox den", NOW, limit=50)
    assert after.edited_excluded == 1 and after.total < before["total"]
    reader.refresh()
    assert engine.as_json(engine.search(reader, "fox den", NOW, limit=50)) == engine.as_json(after)


@pytest.mark.parametrize("broken", ["files", "postings", "trigrams", "commit"])
def test_a_sync_that_breaks_off_changes_nothing(spark, files, tmp_path, monkeypatch, broken):
    root = str(tmp_path / "index")
    found = store.Store(spark, root, parts=2)
    engine.sync(files, found)
    paths = sorted(r.rel_path for r in files.collect())
    now = edited(files, paths[0]).filter(F.col("rel_path") != paths[1])
    held, write = kept(found), store.Store._write

    def failing(self, name, *rest):
        made = write(self, name, *rest)
        if name == broken:
            raise OSError("killed")
        return made

    monkeypatch.setattr(store.Store, "_write", failing)
    monkeypatch.setattr(store, "put_new", lambda *a: broken != "commit" and store_put(*a))
    with pytest.raises((OSError, RuntimeError)):
        engine.sync(now, store.Store(spark, root))
    monkeypatch.undo()
    again = store.Store(spark, root)
    assert kept(again) == held
    report = engine.sync(now, again)
    assert (report["indexed"], report["removed"]) == (1, 1) and kept(again) == fresh(verify.verified(now))


store_put = store.put_new


def test_two_syncs_at_once(spark, files, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    a, b = store.Store(spark, root), store.Store(spark, root)
    engine.sync(files, a)
    monkeypatch.setattr(b, "refresh", lambda: None)  # it began before the other one ended
    with pytest.raises(RuntimeError):
        engine.sync(files.limit(3), b)
    assert store.Store(spark, root).snapshot == a.snapshot


def test_compaction_and_vacuum(spark, files, tmp_path):
    found = store.Store(spark, str(tmp_path / "index"), parts=2, kept=2)
    paths = sorted(r.rel_path for r in files.collect())
    for k in range(4):
        now = files.filter(~F.col("rel_path").isin(paths[:k]))
        engine.sync(edited(now, paths[5 + k]), found)
    want = fresh(verify.verified(edited(now, paths[8])))
    asked = engine.as_json(engine.search(found, "fox den", NOW, limit=50))
    assert kept(found) == want and len(found.snapshot["tables"]["texts"]) > 2
    grams = rows(found.read("trigrams"))
    found.compact()
    assert kept(found) == want and rows(found.read("trigrams")) == grams and all(len(found.snapshot["tables"][n]) == 1 for n in store.GROWING)
    assert engine.as_json(engine.search(found, "fox den", NOW, limit=50)) == asked
    assert engine.sync(edited(now, paths[8]), found)["indexed"] == 0
    engine.sync(files, found)
    segments = {n for n in os.listdir(tmp_path / "index" / "texts")}
    assert segments == {f"seg={s}" for k in found._numbers() for s in found._snapshot(k)["tables"]["texts"]} and len(found._numbers()) == 2


def left_behind(spark, work):
    """Shuffle files that jobs of ``work`` left, once Spark had time to take them away."""
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    there = lambda: {n for d in dirs for _, _, names in os.walk(d) for n in names if n.startswith("shuffle_")}
    before, until = there(), time.monotonic() + 5
    work()
    while there() - before and time.monotonic() < until:
        time.sleep(0.1)
    return there() - before


def test_disk_is_bounded(spark, files, tmp_path, monkeypatch):
    """Jobs leave no shuffles, parts are written one at a time, and rows of segments that lost no record count without a join."""
    monkeypatch.setattr(store, "BATCH", 1)
    found, write, written = store.Store(spark, str(tmp_path / "index"), parts=3), store.Store._write, []
    monkeypatch.setattr(store.Store, "_write", lambda self, name, *args, **how: (written.append(name), write(self, name, *args, **how))[1])
    joined = lambda name: "Join" in found.read(name)._jdf.queryExecution().optimizedPlan().toString()
    paths = sorted(r.rel_path for r in files.collect())
    assert not left_behind(spark, lambda: engine.sync(files.filter(F.col("rel_path") != paths[0]), found))
    assert written.count("postings") == len(next(iter(found.snapshot["tables"]["texts"].values()))) > 1
    assert not joined("postings") and not joined("texts") and len(found.snapshot["whole"]) == 1
    assert not [n for n in os.listdir(tmp_path / "index" / "texts") if "loose" in n]
    # A record that comes tears nothing; one that is edited tears the segment that had it.
    engine.sync(files, found)
    assert not joined("postings") and len(found.snapshot["whole"]) == 2 and kept(found) == fresh(verify.verified(files))
    now = edited(files, paths[5])
    assert not left_behind(spark, lambda: engine.sync(now, found))
    assert joined("postings") and len(found.snapshot["whole"]) == 2
    want, grams, texts = fresh(verify.verified(now)), rows(found.read("trigrams")), rows(found.read("texts"))
    assert kept(found) == want
    # So does one that goes; a snapshot that doesn't say what is whole is read with joins.
    engine.sync(now.filter(F.col("rel_path") != paths[0]), found)
    engine.sync(now, found)
    assert kept(found) == want and rows(found.read("texts")) == texts
    del found.snapshot["whole"]
    assert kept(found) == want and rows(found.read("texts")) == texts
    written.clear()
    assert not left_behind(spark, found.compact)
    assert all(written.count(n) == len(next(iter(found.snapshot["tables"][n].values()))) > 1 for n in ("postings", "texts", "trigrams"))
    assert kept(found) == want and rows(found.read("trigrams")) == grams and rows(found.read("texts")) == texts
    assert not joined("postings") and not joined("texts")
    assert found.spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_trigrams_equal_the_scan(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(2, 9)))
    records = [(f"{k}.md", " ".join(word() for _ in range(30))) for k in range(12)]
    extra = {"world": "main", "scope": "s", "lane": "conversation", "event_time_ms": 5, "body_line": 1, "parses": True, "verify_status": "ok"}
    state = lambda some: spark.createDataFrame(some, "rel_path string, content string").withColumns({k: F.lit(v) for k, v in extra.items()} | {"episode_id": F.col("rel_path")})
    found = store.Store(spark, str(tmp_path / "index"))
    found.sync(state(records))
    found.sync(state(records[3:9] + [("new.md", " ".join(word() for _ in range(30)))]))
    every = [r.term for r in found.vocabulary("main").collect()]
    for _ in range(12):
        needles = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 5))) for _ in range(rng.randint(1, 3))]
        assert {r.term for r in found.terms_with("main", needles).collect()} == {t for t in every if any(n in t for n in needles)}
    assert {r.term for r in found.terms_with("main", ["ab", "abc"]).collect()} == {t for t in every if "ab" in t}
    assert store.parts_of(["abc", "bca"], 8) == sorted({r[0] for r in spark.createDataFrame([("abc",), ("bca",)], "g string").select(store.part_of(F.col("g"), 8)).collect()})


def test_search_verifies_files(spark, tmp_path):
    """What was edited or went since the last sync is left out and counted, and no other file is opened."""
    root, index = str(tmp_path / "journal"), str(tmp_path / "index")
    os.mkdir(root, 0o700)
    corpus.write(stored(spark, turns(12)), root)
    found = store.Store(spark, index)
    engine.sync(engine.records_in(spark, root)[0], found)
    sources = corpus.hashes_at(root)
    first = engine.search(found, "fox den", NOW, limit=50, sources=sources)
    assert first.edited_excluded == 0 and engine.as_json(first) == engine.as_json(engine.search(found, "fox den", NOW, limit=50))
    one, two = list(dict.fromkeys(h["rel_path"] for h in first.hits))[:2]
    with open(f"{root}/{one}", "a") as f:
        f.write("more\n")
    os.unlink(f"{root}/{two}")
    after = engine.search(found, "fox den", NOW, limit=50, sources=sources)
    assert after.edited_excluded == 2 and not {one, two} & {h["rel_path"] for h in after.hits} and after.total == len([h for h in first.hits if h["rel_path"] not in (one, two)])
    files = engine.records_in(spark, root)[0]
    assert engine.as_json(engine.search(found, "fox den", NOW, limit=50, sources=store.hashes_of(files))) == engine.as_json(after)
    engine.sync(files, found)
    # The one that has no good digest any more is still there, the other one isn't.
    assert engine.search(found, "fox den", NOW, limit=50, sources=sources).edited_excluded == 1


def test_paths_are_pushed_to_the_corpus(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "journal")
    os.mkdir(root, 0o700)
    corpus.write(stored(spark, turns(6)), root)
    files = corpus.read(spark, root)
    paths = sorted(p for _, p in corpus.walk(root))
    for name in os.listdir(root):  # a walk would not get through here
        os.chmod(f"{root}/{name}", 0o711)
    assert [r.rel_path for r in files.filter(F.col("rel_path") == paths[2]).collect()] == [paths[2]]
    some = files.filter(F.col("rel_path").isin(paths[0], paths[4], "none/aj1-x.md", "../aj1-x.md")).select("rel_path", "size")
    assert sorted(r.rel_path for r in some.collect()) == [paths[0], paths[4]] and all(r.size for r in some.collect())
    reader = corpus.Reader({"path": root})
    assert list(reader.pushFilters([corpus.EqualTo(("rel_path",), paths[1]), corpus.In(("size",), (1,))])) == [corpus.In(("size",), (1,))]
    assert [p.paths for p in reader.partitions()] == [[paths[1]]] and [r[0] for p in reader.partitions() for r in reader.read(p)] == [paths[1]]


def test_search_goes_by_the_configuration(spark, tmp_path, capsys):
    """Knobs, world and page size come from the owner's file, and weak queries are logged where it says so."""
    root, index, log = (str(tmp_path / n) for n in ("journal", "index", "weak.jsonl"))
    os.mkdir(root, 0o700)
    corpus.write(stored(spark, turns(12)), root)
    owner = tmp_path / "config.json"

    def run(*args):
        assert cli.main(["search", root, *args, "--index", index, "--config", str(owner), "--miss-log", log, "--now-ms", str(NOW)]) == 0
        return json.loads(capsys.readouterr().out.splitlines()[-1])

    assert cli.main(["sync", root, "--index", index]) == 0
    capsys.readouterr()
    owner.write_text('{"default_world": "w", "max_results": 1, "miss_log": true, "confidence_floor": 1000, "miss_log_max_bytes": 100000}')
    found = run("fox den")
    assert found["identities"]["world"] == "w" and len(found["hits"]) <= 1 and found["query"] == "fox den" and found["index"] == {"indexed": 12, "excluded": 0}
    run("zebra")
    lines = [json.loads(x) for x in open(log)]
    assert [x["query"] for x in lines] == ["fox den", "zebra"] and lines[1]["top"] is None and lines[1]["terms"] == ["zebra"] and lines[0]["ts"] == "2023-11-14T22:13:20Z"
    owner.write_text('{"confidence_floor": 1000, "miss_log_max_bytes": 100000, "min_score": 100000}')
    assert run("fox den")["hits"] == [] and len(open(log).readlines()) == 2


def test_status_by_signature(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "journal")
    os.mkdir(root, 0o700)
    corpus.write(stored(spark, turns(4)), root)
    with open(f"{root}/aj1-bad.md", "w") as f:
        f.write("x")
    found, now = store.Store(spark, str(tmp_path / "index")), 10**15
    engine.sync(engine.records_in(spark, root)[0], found, signature=engine.signature_of(spark, root))
    slow = engine.status(engine.records_in(spark, root)[0], found)
    monkeypatch.setattr(engine, "records_in", None)  # no file is opened
    assert engine.status_at(spark, root, found, now) == slow and slow["files"] == 5 and slow["malformed"] == 1
