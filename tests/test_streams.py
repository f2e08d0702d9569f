"""Capture and settling as streams."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.functions import contracts
from strandline.operators import capture, engine, prompts, store, verify
from strandline.streaming import capture_stream
from tests.test_records import BASE, parsed

NOW = 1_700_000_000_000


def deliveries():
    """Turns delivered again, longer and otherwise, over three batches."""
    rng = random.Random(5)
    out = []
    for k in range(60):
        turn = BASE | {"turn_id": str(rng.randint(0, 14)), "assistant_result": "an answer" + " and more" * rng.randint(0, 3)}
        out.append(turn | ({"lane": "none"} if k % 20 == 7 else {}))
    return out


def held(spark, root):
    return {r.rel_path: r.content for r in engine.records_in(spark, root)[0].collect()}


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def written(spark, folder, n=3):
    """The deliveries as three files, the earlier ones older."""
    rows = parsed(spark, deliveries()).drop("value")
    for k in range(n):
        part = rows.filter((F.col("seq") >= k * 60 // n) & (F.col("seq") < (k + 1) * 60 // n)).coalesce(1)
        part.write.mode("append").parquet(folder)
        time.sleep(1.1)  # the source goes by the time of files
    return rows


class Killed(Exception):
    pass


@pytest.mark.parametrize("where", ["never", "publish", "index", "note"])
def test_capture_stream_equals_batch(spark, tmp_path, monkeypatch, where):
    """A batch that broke off anywhere is done again with the same corpus, projection and outcomes."""
    a, b, source = (str(tmp_path / n) for n in ("batch", "stream", "in"))
    for n in (a, b):
        os.mkdir(n, 0o700)
    rows = written(spark, source)
    decided, _ = capture.capture(rows, None, a, NOW)
    want = {r.seq: r.outcome for r in decided.collect()}
    found = store.Store(spark, str(tmp_path / "index"), parts=2)
    take = capture_stream.Capture(found, b, str(tmp_path / "ledger"), NOW)

    def run():
        take.start(stream_of(spark, source, rows.schema), str(tmp_path / "state"), availableNow=True).awaitTermination()

    times = [0]

    def once(f, after):
        def g(*args, **kw):
            times[0] += 1
            made = f(*args, **kw) if after or times[0] != 2 else None
            if times[0] == 2:
                raise Killed
            return made

        return g

    if where != "never":
        if where == "publish":
            monkeypatch.setattr(capture_stream.corpus, "write", once(capture_stream.corpus.write, True))
        elif where == "index":
            monkeypatch.setattr(found, "upsert", once(found.upsert, True))
        else:
            monkeypatch.setattr(capture_stream, "put_new", once(capture_stream.put_new, False))
        with pytest.raises(Exception, match="Killed|StreamingQuery|STREAM_FAILED"):
            run()
        monkeypatch.undo()
    run()
    assert held(spark, b) == held(spark, a)
    assert {r.seq: r.outcome for r in take.outcomes(spark).collect()} == want
    files = engine.records_in(spark, b)[0]
    again = store.Store(spark, str(tmp_path / "index"))
    assert store.freshness(files.select("rel_path", F.sha2(F.col("content").cast("binary"), 256).alias("file_hash")), again)["matches"]
    assert engine.sync(files, again)["indexed"] == 0
    anew = store.Store(spark, str(tmp_path / "anew"))
    engine.sync(files, anew)
    assert sorted(map(tuple, again.statistics().collect())) == sorted(map(tuple, anew.statistics().collect())) and again.read("postings").count() == anew.read("postings").count()


def test_capture_stream_begins_with_the_corpus(spark, tmp_path):
    """A new stream over a corpus that holds turns knows them; a batch that was done is passed over."""
    root, source = str(tmp_path / "journal"), str(tmp_path / "in")
    os.mkdir(root, 0o700)
    capture.capture(parsed(spark, [BASE, BASE | {"turn_id": "b"}]), None, root, NOW)
    rows = parsed(spark, [BASE, BASE | {"turn_id": "b", "assistant_result": "a first answer, and more"}, BASE | {"turn_id": "c"}, BASE | {"user_content": "other"}]).drop("value")
    rows.coalesce(1).write.parquet(source)
    take = capture_stream.Capture(store.Store(spark, str(tmp_path / "index")), root, str(tmp_path / "ledger"), NOW)
    take.start(stream_of(spark, source, rows.schema), str(tmp_path / "state"), availableNow=True).awaitTermination()
    assert [r.outcome for r in take.outcomes(spark).orderBy("seq").collect()] == ["duplicate", "superseded", "published", "conflict"]
    before = held(spark, root)
    number = take.store.snapshot["number"]
    take(rows, 0)
    assert held(spark, root) == before and len(before) == 3 and store.Store(spark, str(tmp_path / "index")).snapshot["number"] == number


def looks(rng, n):
    rows = []
    for t in range(n):
        at = 0
        for _ in range(rng.randint(1, 25)):
            at += rng.choice([20, 60, 90])
            rows.append(("s", str(t), at, rng.choice(["x", "y", None]) if rng.random() < 0.4 else "x"))
    return rows


def test_settled_stream_equals_batch(spark, tmp_path):
    """Shuffled looks in two micro-batches; turns that never settle leave no state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(2)
    rows = looks(rng, 30)
    schema = "session_id string, turn_id string, seen_ms long, payload string"
    want = sorted(map(tuple, prompts.settled(spark.createDataFrame(rows, schema)).collect()))
    early, late = ([r for r in rows if (r[2] <= 600) == first] for first in (True, False))
    source = str(tmp_path / "in")
    for part in (early, late):
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    # The clock's window is longer than the two batches take, so that it doesn't cut between them.
    settled = prompts.settled_stream(stream)
    run = settled.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    end = time.time() + 120
    while time.time() < end and run.isActive:
        p = run.lastProgress
        state = p["stateOperators"][0]["numRowsTotal"] if p and p["stateOperators"] else None
        if p and p["batchId"] >= 2 and state == 0:
            break
        time.sleep(0.5)
    assert run.exception() is None
    run.stop()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    alone = {r[1] for r in early} - {r[1] for r in late}
    assert state == 0 and [r for r in got if r[1] in alone] == [r for r in want if r[1] in alone] and {r[:2] for r in got} <= {r[:2] for r in want} | {(s, t) for s, t, _, _ in late}
