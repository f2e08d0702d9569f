"""Search reports, get, status, configuration, redaction."""

import json

import pytest
from pyspark.sql import functions as F

from strandline.operators import engine, redaction, verify
from strandline.sources import config
from tests.test_records import BASE, stored

NOW = 1_700_000_000_000


@pytest.fixture(scope="module")
def files(spark):
    texts = ["red foxes in the den", "a fox and another fox", "nothing here", "wombats dig"]
    rows = [BASE | {"turn_id": str(i), "user_content": t, "event_time_ms": NOW - i * 86_400_000} for i, t in enumerate(texts)]
    rows.append(BASE | {"turn_id": "e", "user_content": "fox in evaluation", "lane": "evaluation"})
    rows.append(BASE | {"turn_id": "w", "user_content": "fox elsewhere", "world": "other"})
    return stored(spark, rows).select("rel_path", "content").cache()


def test_search_report(spark, files):
    records = engine.indexed(files)
    got = engine.search(records, "fox den", NOW)
    assert got.outcome == "match" and got.total == 2 and len(got.hits) == 2 and got.next_cursor is None
    assert got.hits[0]["matched_terms"] == ["fox", "den"] and "red foxes" in got.hits[0]["snippet"]
    assert got.best_score == got.hits[0]["score"] > got.hits[1]["score"] and got.hits[0]["revision"].startswith("sha256:")
    one = engine.search(records, "fox den", NOW, limit=1)
    two = engine.search(records, "fox den", NOW, limit=1, cursor=one.next_cursor)
    assert [h["episode_id"] for h in one.hits + two.hits] == [h["episode_id"] for h in got.hits] and two.next_cursor is None
    assert engine.search(records, "fox", NOW, cursor=one.next_cursor).outcome == "malformed"
    assert engine.search(records, "foxes", NOW).folded_terms == ["foxe", "fox"]
    assert engine.search(records, "canine", NOW, aliases={"canine": ["fox"]}).total == 2
    assert engine.search(records, "the of", NOW).outcome == "no_match" and engine.search(records, "zebra", NOW).outcome == "no_match"
    assert engine.search(records.limit(0), "fox", NOW, stale=True).outcome == "index_stale"
    assert engine.search(records, "fox", NOW, lanes=("evaluation",)).total == 1 and engine.search(records, "fox", NOW, world="other").total == 1


def test_get(spark, files):
    row = verify.verified(files).filter(F.contains("content", F.lit("red foxes"))).first()
    e, r = row.episode_id, "sha256:" + row.recorded_digest
    got = engine.get(files, e, r)
    assert got.outcome == "match" and got.content == "\n".join(row.content.split("\n")[row.body_line - 1 :]) and got.line_start == row.body_line
    part = engine.get(files, e, r, row.body_line + 3, row.body_line + 3, path=row.rel_path)
    assert part.content == "red foxes in the den" and (part.line_start, part.line_end) == (row.body_line + 3,) * 2
    assert engine.get(files, e, r, 1, 2).content == ""  # before the body
    assert engine.get(files, "x", r).outcome == engine.get(files, e, "sha256:1").outcome == engine.get(files, e, r, 5, 4).outcome == "malformed"
    assert engine.get(files, "aj1-" + "0" * 32, r).outcome == "gone" and engine.get(files, e, r, world="other").outcome == "gone"
    edited = files.withColumn("content", F.regexp_replace("content", "red foxes", "blue foxes"))
    stale = engine.get(edited, e, r)
    assert stale.outcome == "stale_revision" and stale.revision == "" and stale.content == ""
    sealed = verify.reseal_preview(edited).select("rel_path", "content")
    now = engine.get(sealed, e, r)
    assert now.outcome == "stale_revision" and engine.get(sealed, e, now.revision).outcome == "match"


def test_status(spark, files):
    hashes = files.select("rel_path", F.sha2(F.col("content").cast("binary"), 256).alias("file_hash"))
    got = engine.status(files, hashes)
    assert (got["files"], got["episodes"], got["malformed"], got["freshness"]) == (6, 6, 0, "current")
    more = files.unionByName(files.limit(1).withColumn("rel_path", F.lit("copy.md"))).unionByName(spark.createDataFrame([("bad.md", "x")], "rel_path string, content string"))
    got = engine.status(more, hashes)
    assert (got["files"], got["episodes"], got["copies"], got["malformed"], got["freshness"]) == (8, 6, 1, 1, "stale")


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    config.save_capture(path, "team", "default")
    with open(path) as f:
        assert f.read() == '{\n  "capture": {\n    "world": "team",\n    "scope": "default"\n  }\n}\n'
    before = b'{"world_root": "/j", "default_world": "main", "recency_boost": 1e-3, "max_results": "2e1", "capture": {"world": "main"}}'
    after = config.with_capture(before, "w", "s")
    assert list(json.loads(after)) == ["default_world", "recency_boost", "max_results", "capture", "journal_root"] and '"recency_boost": 0.001' in after
    read = config.parse(after.encode())
    assert (read.journal_root, read.default_world, read.max_results, read.world, read.scope) == ("/j", "w", 20, "w", "s")
    for bad in (b"[]", b'{"a": 1}', b'{"context_window": 11}', b'{"context_window": 2.5}', b'{"min_score": NaN}', b'{"min_score": -1}', b'{"journal_root": "j"}', b'{"journal_root": "/a", "world_root": "/b"}', b'{"miss_log": 1}', b'{"capture": {"scope": "a/b"}}', b'{"miss_log_max_bytes": 184467440737095510e2}', b'{"max_results": 1, "max_results": 1}'):
        with pytest.raises(config.MalformedConfig):
            config.parse(bad)


def test_redaction(spark):
    entry = {"type": "user", "uuid": "ab12-XY", "cwd": "/home/me", "message": {"role": "user", "content": "my secret plan\n\n<command-name>/go</command-name> now"}, "n": 3}
    out = redaction.redacted(entry)
    assert out == redaction.redacted(entry) and out["type"] == "user" and out["n"] == 3 and out["cwd"] == "/redacted/workspace"
    assert len(out["uuid"]) == 7 and out["uuid"][4:] == "-XY" and out["uuid"] != entry["uuid"]
    text = out["message"]["content"]
    words = text.replace("<command-name>", " ").replace("</command-name>", " ").replace("/", "").split()
    assert text.count("\n") == 2 and "<command-name>/" in text and set(words) <= set(redaction.PLACEHOLDERS)
    rows = redaction.redact(spark.createDataFrame([(1, json.dumps(entry)), (2, "no"), (3, None)], "k int, value string")).orderBy("k").collect()
    assert "<" not in rows[0].value and json.loads(rows[0].value) == out and rows[1].value is None and rows[2].value is None
