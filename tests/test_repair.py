"""Replaying transcripts under records of an older projection."""

import json
import os

import pytest

from strandline.operators import repair, transcripts


def test_replay(spark):
    user = lambda t, u, **k: {"type": "user", "uuid": u, "timestamp": "2024-01-02T03:04:05Z", "message": {"content": t}, **k}
    say = lambda t: {"type": "assistant", "uuid": "x" + t, "message": {"stop_reason": "end_turn", "content": t}}
    log = [user("<system-reminder>x</system-reminder>", "m0"), user("a question", "u1"), user("expanded body", "m1", isMeta=True), say("answer"), user("unanswered", "u2")]
    lines = spark.createDataFrame([("s", i, json.dumps(o)) for i, o in enumerate(log)], "session string, line_no long, value string")
    found = transcripts.entries(lines)
    rows = [("e1", "s", "u1"), ("e2", "s", "m1"), ("e3", "s", "m0"), ("e4", "s", "u2"), ("e5", "gone", "u1"), ("e6", "s", "nowhere")]
    records = spark.createDataFrame([(e, e + ".md", s, t, 7, "main", "default", "conversation", "h", "p3") for e, s, t in rows] + [("new", "n", "s", "u1", 7, "main", "default", "conversation", "h", "p4")], "episode_id string, rel_path string, session_id string, turn_id string, event_time_ms long, world string, scope string, lane string, harness string, capture_policy string")
    report = repair.replayed(records, found, "p3")
    got = {r.episode_id: (r.action, r.turn_id, r.reanchored) for r in report.collect()}
    bad = ("not_publishable", None, None)
    assert got == {"e1": ("replace", "u1", False), "e2": ("replace", "u1", True), "e3": bad, "e4": bad, "e5": ("no_transcript", None, None), "e6": bad}
    one = repair.replacements(report).collect()
    assert len(one) == 1 and one[0].replaces == ["e1", "e2"] and one[0].assistant_result == "answer" and one[0].event_time_ms == 1704164645000


OLD, NEW = "p3", "p4"


def _corpus(spark, tmp_path):
    """A corpus of old records of one session, its transcript as a file, and their paths by turn."""
    from strandline.functions.identity import rendered
    from strandline.operators import capture
    from strandline.sources import corpus

    user = lambda t, u, **k: {"type": "user", "uuid": u, "timestamp": "2024-01-02T03:04:05Z", "message": {"content": t}, **k}
    say = lambda t: {"type": "assistant", "uuid": "x" + t, "message": {"stop_reason": "end_turn", "content": t}}
    log = [user("a question", "u1"), user("expanded body", "m1", isMeta=True), say("answer"), user("more", "u2"), say("said"), user("unanswered", "u3")]
    for folder in ("logs/a", "logs/b"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "logs/a/s.jsonl").write_text("\n".join(map(json.dumps, log)) + "\n{broken\n")
    (tmp_path / "logs/b/s.jsonl").write_text(json.dumps(user("another workspace", "u1")) + "\n")
    turns = [("s", "u1", "h1"), ("s", "m1", "h2"), ("s", "u2", None), ("s", "u3", None), ("gone", "u1", None)]
    kind = "schema_version long, world string, scope string, lane string, harness string, adapter_version string, session_id string, turn_id string, event_time_ms long, capture_policy string, turn_outcome string, user_content string, assistant_result string, tools array<string>, workspace_root string, branch_of string, host string, capture_time_ms long"
    rows = [(1, "w", "default", "conversation", "chat", "1", s, t, 1704164645000, OLD, "completed", "old words", "old reply", [], "/work", None, h, 5) for s, t, h in turns]
    ready = capture.prepared(spark.createDataFrame(rows, kind)).withColumn("content", rendered())
    root = str(tmp_path / "corpus")
    corpus.write(ready, root).collect()
    paths = {(r.session_id, r.turn_id): r.rel_path for r in ready.collect()}
    (tmp_path / "corpus/aj1-incomplete.md").write_text(f"---\ncapture_policy: {OLD}\nsession_id: s\n---\n\n")
    return root, paths


def _repair(spark, tmp_path, root):
    from pyspark.sql import functions as F

    from strandline.sources import corpus

    files = corpus.read(spark, root).filter("kind = 'episode'").select("rel_path", F.col("content").cast("string").alias("content"))
    found = transcripts.entries(transcripts.logs(spark, str(tmp_path / "logs/*/*.jsonl")))
    return repair.Repair(spark, root, str(tmp_path / "ledger")), (files, found, OLD, NEW, "9")


def _standing(root):
    from strandline.sources import corpus

    return {p for k, p in corpus.walk(root) if k == "episode"}


WHOLE = dict(found=6, transcript_located=4, reanchored=1, would_publish=3, would_delete=3, published=3, deleted=3, not_publishable=1, unrepairable=2, kept=0)


def test_repair_replaces_and_indexes(spark, tmp_path):
    from strandline.operators.store import Store

    root, paths = _corpus(spark, tmp_path)
    before = _standing(root)
    job, what = _repair(spark, tmp_path, root)
    store = Store(spark, str(tmp_path / "index"))
    assert job.run(*what, 99, store).first().asDict() == WHOLE
    new = {r.rel_path: r for r in job._read("payloads").collect()}
    assert _standing(root) == before - {paths["s", t] for t in ("u1", "m1", "u2")} | set(new) and len(new) == 2
    # Two records of one turn give one replacement, beside them, with what the first one by path says of the host.
    one = next(r for r in new.values() if r.turn_id == "u1")
    text = open(f"{root}/{one.rel_path}").read()
    first = min(paths["s", "u1"], paths["s", "m1"])
    assert one.world == "w" and f"host: {'h1' if first == paths['s', 'u1'] else 'h2'}\n" in text and "workspace_root: /work\n" in text and "a question" in text
    assert {r.rel_path for r in store.read("episodes").collect()} == _standing(root) - {"aj1-incomplete.md"}
    # A run of the same repair changes nothing and says the same; one with a ledger of its own has nothing to replace.
    assert job.run(*what, 100).first().asDict() == WHOLE
    again = repair.Repair(spark, root, str(tmp_path / "ledger2")).run(*what, 100).first()
    assert (again.found, again.would_publish, again.published) == (3, 0, 0)


def test_repair_goes_on_where_it_broke_off(spark, tmp_path):
    root, paths = _corpus(spark, tmp_path)
    job, what = _repair(spark, tmp_path, root)
    job.plan(*what)
    assert job.account().first().asDict() == WHOLE | {"published": 0, "deleted": 0}
    before = _standing(root)
    job.publish(7)
    assert before < _standing(root)  # nothing is taken away before all is published
    os.unlink(f"{root}/{paths['s', 'u1']}")  # as a removal that broke off would leave it
    second, what = _repair(spark, tmp_path, root)
    assert second.run(*what, 8).first().asDict() == WHOLE
    assert "capture_time_ms: 7\n" in open(f"{root}/{job._read('payloads').first().rel_path}").read()


def test_repair_keeps_what_it_cannot_replace(spark, tmp_path):
    root, paths = _corpus(spark, tmp_path)
    job, what = _repair(spark, tmp_path, root)
    job.plan(*what)
    new = {r.turn_id: r.rel_path for r in job._read("payloads").collect()}
    job.publish(7)
    os.unlink(f"{root}/{new['u2']}")  # the replacement of u2 is gone
    with open(f"{root}/{paths['s', 'm1']}", "a") as f:  # edited since the plan
        f.write("a note\n")
    assert {r.rel_path: r.outcome for r in job.remove().collect()} == {paths["s", "u1"]: "deleted", paths["s", "m1"]: "changed"}
    assert {paths["s", "m1"], paths["s", "u2"], paths["s", "u3"]} <= _standing(root)
    assert {r.rel_path: r.result for r in job.records().collect() if r.result} == {paths["s", "u1"]: "replaced", paths["s", "m1"]: "kept", paths["s", "u2"]: "kept"}
    account = job.account().first()
    assert (account.published, account.deleted, account.kept) == (1, 1, 2)


def test_repair_does_not_trust_another_revision(spark, tmp_path):
    """A replacement that was published and edited before: the capture conflicts, and the old record stays."""
    root, paths = _corpus(spark, tmp_path)
    job, what = _repair(spark, tmp_path, root)
    job.plan(*what)
    at = {r.turn_id: r.rel_path for r in job._read("payloads").collect()}["u2"]
    job.publish(7)
    text = open(f"{root}/{at}").read()
    open(f"{root}/{at}", "w").write(text.replace("said", "sad"))
    other = repair.Repair(spark, root, str(tmp_path / "ledger2"))
    assert other.run(*what, 8).first().kept == 1
    assert paths["s", "u2"] in _standing(root) and "sad" in open(f"{root}/{at}").read()


def test_repair_from_the_command_line(spark, tmp_path):
    from strandline import __main__ as cli

    root, paths = _corpus(spark, tmp_path)
    command = ["repair", root, "--index", str(tmp_path / "index"), "--transcripts", str(tmp_path / "logs/*/*.jsonl"), "--old-policy", OLD, "--new-policy", NEW, "--ledger", str(tmp_path / "ledger")]
    before = _standing(root)
    assert cli.run(cli.parser().parse_args(command), spark) == WHOLE | {"published": 0, "deleted": 0} and _standing(root) == before
    assert cli.run(cli.parser().parse_args([*command, "--apply"]), spark) == WHOLE and paths["s", "u1"] not in _standing(root)


def test_repair_needs_another_policy(spark, tmp_path):
    with pytest.raises(ValueError):
        repair.Repair(spark, str(tmp_path), str(tmp_path / "l")).plan(None, None, OLD, OLD, "9")


def test_removal_looks_first(tmp_path):
    import hashlib

    from strandline.sources import corpus

    (tmp_path / "aj1-x.md").write_bytes(b"x")
    os.symlink(tmp_path / "aj1-x.md", tmp_path / "aj1-l.md")
    sha = hashlib.sha256(b"x").hexdigest()
    assert corpus.remove_one(str(tmp_path), "aj1-l.md", sha) == "changed"  # a link is no record
    assert corpus.remove_one(str(tmp_path), "../aj1-x.md", sha) == "changed"
    assert corpus.remove_one(str(tmp_path), "aj1-x.md", "0" * 64) == "changed"
    assert corpus.remove_one(str(tmp_path), "aj1-x.md", sha) == "deleted"
    assert corpus.remove_one(str(tmp_path), "aj1-x.md", sha) == "gone"
