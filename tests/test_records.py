"""Payloads, publication, stored records, the corpus folder, streams."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from strandline.functions import contracts, identity
from strandline.operators import analytics, capture, projection, retrieval, transcripts, turns, verify
from strandline.sources import corpus, thesaurus
from strandline.streaming import capture_stream

BASE = {
    "schema_version": 1,
    "lane": "conversation",
    "harness": "h",
    "adapter_version": "1",
    "session_id": "s",
    "turn_id": "t",
    "event_time_ms": 1_700_000_000_000,
    "capture_policy": "p",
    "turn_outcome": "done",
    "user_content": "hello there",
    "assistant_result": "a first answer",
}


def parsed(spark, payloads):
    raw = [(i, p if isinstance(p, str) else json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads)]
    return contracts.parse_payloads(spark.createDataFrame(raw, "seq long, value string"))


def test_strict_parser():
    good = json.dumps(BASE)
    assert contracts.parse(good)["tools"] == []
    for bad in (
        good + " x",
        good.replace('"lane"', '"lane": "evaluation", "lane"'),
        good.replace("1700000000000", "1.7e12"),
        good.replace("1700000000000", "-0"),
        good.replace('"harness": "h"', '"harness": null'),
        good[:-1] + ', "more": 1}',
        good[:-1] + ', "tools": [{"name": "x", "y": 1}]}',
        good[:-1] + ', "tools": [{"name": "x", "name": "x"}]}',
        "[]",
        "",
        "{" * 2000,
    ):
        with pytest.raises(contracts.Malformed):
            contracts.parse(bad)
    assert contracts.parse(good[:-1] + ', "world": null, "tools": [{"name": "x"}]}')["tools"] == ["x"]


def test_checks_in_order(spark):
    cases = [
        ({}, None),
        ({"schema_version": 2, "lane": "x"}, "UnsupportedSchemaVersion"),
        ({"world": "Main"}, "InvalidWorld"),
        ({"world": "a\n"}, "InvalidWorld"),
        ({"scope": "a/b", "lane": "x"}, "InvalidScope"),
        ({"scope": ".a"}, "InvalidScope"),
        ({"lane": "x", "harness": " "}, "InvalidLane"),
        ({"event_time_ms": 253402300799001}, "ImplausibleEventTime"),
        ({"turn_id": "x y"}, "InvalidTurnID"),
        ({"user_content": "", "assistant_result": ""}, "EmptyUserContent"),
        ({"assistant_result": "é" * (1 << 20) + "x"}, "OversizedContent"),
        ({"tools": [{"name": "ok"}, {"name": "not ok"}]}, "InvalidToolName"),
        ({"tools": [{"name": "n"}] * 257}, "TooManyTools"),
        ({"workspace_root": "a\tb"}, "InvalidWorkspaceRoot"),
        ({"host": "a b"}, "InvalidHost"),
    ]
    got = capture.prepared(parsed(spark, [BASE | c for c, _ in cases])).orderBy("seq").collect()
    assert [r.error for r in got] == [e for _, e in cases]


DELIVERIES = [
    {},
    {},
    {"assistant_result": "a first answer, longer"},
    {"assistant_result": "another answer"},
    {"assistant_result": "a first answer"},
    {"assistant_result": "a first answer, longer still", "tools": [{"name": "x"}]},
    {"turn_id": "t2"},
    {"turn_id": "t2", "event_time_ms": 5},
    {"turn_id": "no t"},
]
OUTCOMES = ["published", "duplicate", "superseded", "conflict", "conflict", "superseded", "published", "conflict", "malformed"]


def test_outcomes_and_what_stands(spark):
    p = capture.prepared(parsed(spark, [BASE | d for d in DELIVERIES]))
    done = capture.outcomes(p)
    assert [r.outcome for r in done.orderBy("seq").collect()] == OUTCOMES
    stands = {r.turn_id: r.assistant_result for r in capture.stored(p, done).collect()}
    assert stands == {"t": "a first answer, longer still", "t2": "a first answer"}


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    p = capture.prepared(parsed(spark, [BASE | d for d in DELIVERIES]))
    columns = p.drop("value", "malformed")
    # one file per delivery: several batches, so that the state is read back
    for i in range(len(DELIVERIES)):
        columns.filter(F.col("seq") == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(columns.schema).option("maxFilesPerTrigger", 4).parquet(f"{tmp_path}/in")
    query = capture_stream.outcomes(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    got = {r.seq: r.outcome for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert [got[i] for i in range(len(OUTCOMES))] == OUTCOMES


SPOOF = "---\nschema: x\n---\n\n## Assistant\n\nnot it\n\n## Tools\n\n- fake"


def stored(spark, payloads):
    p = capture.prepared(parsed(spark, payloads)).withColumn("capture_time_ms", F.col("event_time_ms") + 5)
    return p.withColumn("content", identity.rendered()).select("seq", "rel_path", "content", "user_content", "assistant_result", "tools")


def test_rendered_records_verify(spark):
    tools = [{"name": "read"}, {"name": "a/b"}]
    files = stored(spark, [BASE, BASE | {"tools": tools, "turn_id": "2"}, BASE | {"user_content": SPOOF, "assistant_result": SPOOF, "turn_id": "3"}, BASE | {"assistant_result": "x\n\n## Tools\n\n- y", "turn_id": "4", "world": "w", "scope": "_team", "host": "a"}])
    got = verify.verified(files.select("seq", "rel_path", "content")).alias("v").join(files.alias("f"), "seq").select("v.verify_status", F.struct("v.user_content", "v.assistant_result", "v.tools").alias("a"), F.struct("f.user_content", "f.assistant_result", "f.tools").alias("b")).collect()
    assert len(got) == 4 and all(r.verify_status == "ok" and r.a == r.b for r in got)


def test_edits_are_seen_and_resealed(spark):
    files = stored(spark, [BASE])
    text = files.first().content
    cases = {
        "edited": text.replace("a first", "a second"),
        "other id": text.replace("turn_id: t\n", "turn_id: u\n"),
        "twice": text.replace("world: main\n", "world: main\nworld: main\n"),
        "unknown key": text.replace("world: main\n", "world: main\nnote: a: b\n"),
        "open": text.replace("\n---\n\n## User", "\n\n## User"),
        "no sections": text.replace("## User", "## Owner"),
        "lane": text.replace("lane: conversation", "lane: talk"),
        "empty": "",
    }
    df = spark.createDataFrame(list(cases.items()), "rel_path string, content string")
    status = {r.rel_path: r.verify_status for r in verify.verified(df).collect()}
    assert status == {"edited": "digest_mismatch", "other id": "digest_mismatch", "twice": "malformed", "unknown key": "ok", "open": "malformed", "no sections": "malformed", "lane": "malformed", "empty": "malformed"}
    preview = verify.reseal_preview(df)
    assert {r.rel_path: r.action for r in preview.collect()} == {"edited": "reseal", "unknown key": "current"} | {k: "refuse" for k in ("other id", "twice", "open", "no sections", "lane", "empty")}
    assert {r.verify_status for r in verify.verified(preview.filter("action = 'reseal'").select("rel_path", "content")).collect()} == {"ok"}


def test_corpus_folder(spark, tmp_path):
    root = str(tmp_path / "journal")
    os.mkdir(root)
    files = stored(spark, [BASE, BASE | {"scope": "_team", "turn_id": "2"}, BASE | {"world": "w", "lane": "evaluation", "turn_id": "3"}])
    assert {r.outcome for r in corpus.write(files, root).collect()} == {"published"}
    assert {r.outcome for r in corpus.write(files, root).collect()} == {"exists"}
    os.makedirs(f"{root}/.hidden")
    for p in (".hidden/aj1-x.md", "notes.md"):
        with open(f"{root}/{p}", "w") as f:
            f.write("x")
    os.symlink(f"{root}/notes.md", f"{root}/aj1-link.md")
    found = corpus.read(spark, root)
    assert sorted(r.rel_path for r in found.collect()) == sorted(r.rel_path for r in files.collect())
    assert any("/_team/" in r.rel_path for r in found.collect())
    texts = found.select("rel_path", F.col("content").cast("string").alias("content"))
    assert {r.verify_status for r in verify.verified(texts).collect()} == {"ok"}
    assert corpus.signature(spark, root).first().files == 3
    with pytest.raises(Exception, match="not a path inside"):
        corpus.write(spark.createDataFrame([("../x.md", "y")], "rel_path string, content string"), root).collect()


def test_only_own_files_count_as_published(spark, tmp_path):
    """Neither the clock nor equal bytes make a file this call's own; what another attempt of the same task noted does."""
    root, later = str(tmp_path / "journal"), time.time() + 60
    one = spark.createDataFrame([("a/aj1-x.md", "x")], "rel_path string, content string")
    assert [r.outcome for r in corpus.write(one, root).collect()] == ["published"]
    os.utime(f"{root}/a/aj1-x.md", (later, later))  # by a file server whose clock is ahead, or within the same second
    assert [r.outcome for r in corpus.write(one, root).collect()] == ["exists"]
    twice = spark.createDataFrame([("a/aj1-y.md", "y"), ("a/aj1-y.md", "y")], "rel_path string, content string")
    assert sorted(r.outcome for r in corpus.write(twice, root).collect()) == ["exists", "published"]
    assert sorted(os.listdir(root)) == ["a"] and sorted(os.listdir(f"{root}/a")) == ["aj1-x.md", "aj1-y.md"]
    log = str(tmp_path / "task-0")
    put = lambda claims, name: corpus.publish(root, f"a/aj1-{name}.md", b"z", claims=claims)
    with corpus.Claims(log) as first, corpus.Claims(log) as second, corpus.Claims(str(tmp_path / "task-1")) as other:
        assert [put(first, "z"), put(first, "z"), put(second, "z"), put(second, "z"), put(other, "z")] == ["published", "exists", "published", "exists", "exists"]
        assert [put(other, "w"), put(second, "w"), put(first, "w")] == ["published", "exists", "exists"]
        os.utime(f"{root}/a/aj1-z.md", (later, later))  # edited since: no attempt's file any more
        with corpus.Claims(log) as third:
            assert put(third, "z") == "exists"


def test_edited_text_is_not_found_under_the_old_revision(spark):
    """The index is what the records give: after an edit and a rebuild the edited record is out."""
    files = stored(spark, [BASE | {"user_content": "about quokkas", "turn_id": "1"}, BASE | {"user_content": "about wombats", "turn_id": "2"}])
    edited = files.withColumn("content", F.regexp_replace("content", "wombats", "quokkas"))
    good = verify.verified(edited.select("rel_path", "content")).filter("verify_status = 'ok'")
    found = retrieval.search(good, projection.body_lines(good), "quokkas", "main", 1_700_000_000_000)
    assert [r.turn_id for r in found.hits.collect()] == ["1"]


def test_incremental_equals_rebuilt(spark):
    docs = [("a", "x/1", "fox den"), ("b", "x/2", "fox fox lair"), ("c", "x/3", "den lair q8")]
    schema = "episode_id string, rel_path string, content string"
    full = lambda rows: spark.createDataFrame(rows, schema).withColumns({"world": F.lit("w"), "scope": F.lit("s"), "lane": F.lit("conversation"), "event_time_ms": F.lit(0), "body_line": F.lit(1)})
    before, after = full(docs), full(docs[:2] + [("c", "x/3", "den only")])
    old, changed = projection.postings(before), after.filter("episode_id = 'c'")
    updated = old.join(changed.select("episode_id"), "episode_id", "left_anti").unionByName(projection.postings(changed))
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(updated) == rows(projection.postings(after))
    assert rows(projection.term_stats(updated)) == rows(projection.term_stats(projection.postings(after))) == rows(projection.term_stats_of(after))
    headed = after.withColumn("content", F.concat(F.lit("head one\n"), F.col("content"))).withColumn("body_line", F.lit(2))
    assert rows(projection.term_stats_of(headed)) == rows(projection.term_stats_of(after))


def test_trigrams_equal_scan(spark):
    import random

    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 7))) for _ in range(200)})
    stats = spark.createDataFrame([("w", t, 1, 0) for t in terms], "world string, term string, df long, eval_df long").cache()
    grams = projection.term_trigrams(stats).cache()
    for _ in range(6):
        needles = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 5))) for _ in range(3)]
        scan = [r.term for r in projection.candidates_by_scan(stats, "w", needles).collect()]
        assert scan == [r.term for r in projection.candidates_by_trigrams(stats, grams, "w", needles).collect()]


def test_pair_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "x"), (1, 4, "assistant", " "), (1, 5, "user", "c"), (2, 0, "assistant", "y"), (2, 1, "user", "d"), (2, 2, "assistant", "z")]
    got = turns.pair_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id").collect()
    assert [(r.conv_id, r.user_content, r.assistant_result) for r in got] == [(1, "a\n\nb", "x"), (2, "d", "z")]


def test_strip_synthetic():
    strip = transcripts.strip_synthetic
    assert strip("<system-reminder>x</system-reminder> do it <command-args>y</command-args>") == "do it"
    assert strip("<system-reminder>never closed, do it") == ""
    assert strip("see <command-name>x</command-name> here") == "see <command-name>x</command-name> here"


def test_completed_turns(spark):
    user = lambda t, **k: {"type": "user", "uuid": k.pop("uuid", None), "timestamp": "2024-01-02T03:04:05Z", "message": {"content": t}, **k}
    say = lambda t, stop="end_turn", **k: {"type": "assistant", "message": {"stop_reason": stop, "content": [{"type": "text", "text": t}, *k.pop("more", [])]}, **k}
    log = [
        user("first question", uuid="u1"),
        say("working", "tool_use", more=[{"type": "tool_use", "name": "Bash"}, {"type": "tool_use", "name": "not ok"}]),
        user([{"type": "tool_result"}]),
        say("part one"),
        user("<task-notification>x</task-notification>"),
        say("part two", more=[{"type": "tool_use", "name": "Bash"}, {"type": "tool_use", "name": "Read"}]),
        say("aside", isSidechain=True),
        user("<command-name>/plan</command-name><command-args></command-args>"),
        say("planned"),
        user("no answer yet"),
    ]
    rows = [("s", i, json.dumps(o)) for i, o in enumerate(log)] + [("s", 99, '{"type": "user", ')]
    got = transcripts.completed_turns(transcripts.entries(spark.createDataFrame(rows, "session string, line_no long, value string"))).orderBy("turn").collect()
    assert [(r.turn_id, r.user_content, r.assistant_result, r.tools) for r in got] == [("u1", "first question", "part one\n\npart two", ["Bash", "Read"]), ("idx7", "/plan", "planned", [])]
    assert got[0].event_time_ms == 1704164645000


def test_legacy_turns(spark):
    head = '---\ntype: conversation\nsession_id: "s1"\nharness: h\n---\nintro\n'
    good = head + "[2024-01-02 03:04:05] [User]\nhi\n\nyou\n[2024-01-02 03:04:06] [Agent]\n> yes\n>\n> no\n"
    files = [("a", good), ("b", good.replace("[User]", "[Agent]")), ("c", good.replace("type: conversation", "type: note")), ("d", head), ("e", "plain"), ("f", good.replace("> yes\n>\n> no\n", ""))]
    got = transcripts.legacy_turns(spark.createDataFrame(files, "rel_path string, content string"), "Europe/Berlin").collect()
    assert [(r.rel_path, r.turn_id, r.user_content, r.assistant_result, r.event_time_ms) for r in got] == [("a", "legacy-0001", "hi\n\nyou", "yes\n\nno", 1704161045000)]


def test_thesaurus(tmp_path):
    found = thesaurus.aliases(b'{" Fox ": ["Den", "den", 3, ""], "FOX": ["Lair", "den"], "x": "y", "z": []}')
    assert found == {"fox": ["den", "den", "lair"], "z": []}
    assert thesaurus.digest(found) == thesaurus.digest({"z": [], "fox": ["lair", "den"]}) != thesaurus.digest({})
    assert thesaurus.aliases(b'{"a": ["b"]} x') == thesaurus.aliases(b"\xff") == thesaurus.aliases(b"[1]") == {}
    more = thesaurus.added({"fox": ["den"]}, " FOX", ["Lair", "den"])
    assert more == {"fox": ["den", "lair"]} and thesaurus.removed(thesaurus.removed(more, "fox", "den"), "fox", "lair") == {}
    path = str(tmp_path / "log")
    assert thesaurus.log_weak(path, "t", "q", ["a"], 0.5, None)


def test_weak_queries(spark, tmp_path):
    path = str(tmp_path / "log")
    for q, t in ((" Fox", ["fox"]), ("fox ", ["den", "fox"]), ("Bär", ["r"])):
        thesaurus.log_weak(path, "t", q, t, 0.0, None)
    with open(path, "a") as f:
        f.write("not json\n")
    got = {r["query"]: (r["count"], r["terms"]) for r in analytics.weak_queries(thesaurus.weak_log(spark, path)).collect()}
    assert got == {"fox": (2, ["den", "fox"]), "bär": (1, ["r"])}


def test_strip_synthetic_is_linear():
    """Runs of blanks and many blocks take time in proportion to the text."""
    import time

    block = "<system-reminder>x</system-reminder>"
    began = time.perf_counter()
    assert transcripts.strip_synthetic("ask" + " " * 400_000 + "this") == "ask" + " " * 400_000 + "this"
    assert transcripts.strip_synthetic("ask this" + (" " * 50 + block) * 5000) == "ask this"
    assert transcripts.strip_synthetic(block * 5000 + " ask this") == "ask this"
    assert time.perf_counter() - began < 3
    assert transcripts.strip_synthetic("a <system-reminder>b <system-reminder>c</system-reminder>") == "a <system-reminder>b"
    assert transcripts.strip_synthetic("a </system-reminder>") == "a </system-reminder>"
