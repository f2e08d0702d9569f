"""Capture as a stream: the state of a turn is what is stored of it, and every delivery gets an outcome.

``outcomes`` keeps that state with the stream and yields what would become of each delivery. ``Capture`` takes
each micro-batch into a corpus and its projection: the corpus is the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from strandline.functions.identity import DEFAULT, Formats, rendered
from strandline.operators import capture, verify
from strandline.operators.capture import COVERED, Turn
from strandline.operators.store import Store
from strandline.sources import corpus
from strandline.sources.folders import names_in, put_new

OUT = "episode_id string, seq long, payload_digest string, outcome string"


class Publication(StatefulProcessor):
    """First delivery wins; equal ones are duplicates, strict extensions replace it, others conflict.

    The rows of a turn in one micro-batch come in several pieces, in any order: all are put in order before
    the first is judged. Texts are held once for each digest, however often a delivery is repeated.
    """

    def init(self, handle) -> None:
        self.state = handle.getValueState("turn", "digest string, covered string, result string, tools string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        turn = Turn()
        if self.state.exists():
            digest, covered, result, tools = self.state.get()
            turn.digest, turn.covered, turn.result, turn.tools = digest, (covered,), result, json.loads(tools)
        order: list[tuple[int, str]] = []
        texts: dict[str, tuple] = {}
        for pdf in rows:
            order += zip(pdf["seq"].tolist(), pdf["payload_digest"])
            for d, c, a, t in zip(pdf["payload_digest"], pdf["covered"], pdf["assistant_result"], pdf["tools"]):
                if d not in texts:
                    texts[d] = (c,), a, json.loads(t)
        order.sort()
        for at in range(0, len(order), 10_000):
            part = order[at : at + 10_000]
            out = [turn.deliver(d, *texts[d]) for _, d in part]
            yield pd.DataFrame({"episode_id": key[0], "seq": [n for n, _ in part], "payload_digest": [d for _, d in part], "outcome": out})
        if turn.digest is not None:
            self.state.update((turn.digest, turn.covered[0], turn.result, json.dumps(turn.tools)))

    def close(self) -> None:
        pass


def outcomes(deliveries: DataFrame) -> DataFrame:
    """Outcomes of a stream of ``prepared`` deliveries with ``seq``. Event time plays no part, so nothing is late.

    Needs the RocksDB state store. Invalid deliveries come out as malformed without touching any state.
    """
    rows = deliveries.filter(F.col("error").isNull()).select(
        "episode_id", F.col("seq").cast("long"), "payload_digest", F.to_json(F.struct(*COVERED)).alias("covered"), "assistant_result", F.to_json(F.coalesce("tools", F.array().cast("array<string>"))).alias("tools")
    )
    done = rows.groupBy("episode_id").transformWithStateInPandas(Publication(), OUT, "Append", "None")
    bad = deliveries.filter(F.col("error").isNotNull()).select("episode_id", F.col("seq").cast("long"), "payload_digest", F.lit("malformed").alias("outcome"))
    return done.unionByName(bad)


class Capture:
    """What ``foreachBatch`` calls: deliveries are decided, published and indexed once, however often a batch comes.

    A ledger folder has, for each batch, what was decided (written before anything is published) and a note
    once all of it is done. A batch that comes again after the note is passed over. One that broke off before
    goes on with what was decided then: a file that is there already is its own, and an indexed one is
    unchanged. What is known of a turn comes from the corpus, by the projection's paths, so a stream that
    begins anew goes on with what is stored.
    """

    def __init__(self, store: Store, root: str, ledger: str, now_ms: int, order: str = "seq", formats: Formats = DEFAULT):
        self.store, self.root, self.ledger, self.now_ms, self.order, self.formats = store, root, ledger.rstrip("/"), now_ms, order, formats

    def _verified(self, files: DataFrame) -> DataFrame:
        return verify.verified(files, self.formats)

    def decide(self, payloads: DataFrame, folder: str) -> None:
        """Write the outcomes of a batch, and the files that are to stand after it."""
        ready = capture.prepared(payloads, self.formats).withColumn("capture_time_ms", F.lit(self.now_ms))
        if "malformed" in payloads.columns:
            ready = ready.withColumn("error", F.when(F.col("malformed"), "MalformedPayload").otherwise(F.col("error")))
        ids = ready.filter("error IS NULL").select("episode_id").distinct()
        at = self.store.read("episodes").join(ids, "episode_id", "left_semi").select("rel_path")
        files = corpus.contents_at(self.root)(at).withColumn("content", F.col("content").cast("string"))
        known = capture.recorded(self._verified(files))
        decided = capture.outcomes(ready, self.order, known)
        decided.write.mode("overwrite").parquet(f"{folder}/outcomes")
        decided = ready.sparkSession.read.parquet(f"{folder}/outcomes")
        standing = capture.stored(ready, decided, self.order).withColumn("content", rendered(self.formats))
        standing = standing.join(known.select("episode_id", F.lit(True).alias("replace")), "episode_id", "left")
        standing.select("rel_path", "content", F.coalesce("replace", F.lit(False)).alias("replace")).write.mode("overwrite").parquet(f"{folder}/standing")

    def __call__(self, payloads: DataFrame, batch: int) -> None:
        spark, folder = payloads.sparkSession, f"{self.ledger}/batch-{batch:012d}"
        there = names_in(spark, folder)
        if "done" in there:
            return
        self.store.refresh()
        # Both tables are whole only if the second one is.
        if "_SUCCESS" not in names_in(spark, f"{folder}/standing"):
            self.decide(payloads, folder)
        standing = spark.read.parquet(f"{folder}/standing")
        corpus.write(standing, self.root)
        self.store.upsert(standing.select("rel_path", "content"), self._verified)
        put_new(spark, f"{folder}/done", json.dumps({"batch": batch}))

    def outcomes(self, spark) -> DataFrame:
        """The outcomes of all batches that are done."""
        done = [n for n in names_in(spark, self.ledger) if "done" in names_in(spark, f"{self.ledger}/{n}")]
        return spark.read.parquet(*[f"{self.ledger}/{n}/outcomes" for n in done])

    def start(self, payloads: DataFrame, checkpoint: str, **trigger):
        """Begin (or go on with) the stream of payloads."""
        if self.store.snapshot is None:
            files = corpus.read(payloads.sparkSession, self.root).filter("kind = 'episode'").select("rel_path", F.col("content").cast("string").alias("content"))
            self.store.sync(files, derive=self._verified)
        return payloads.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**trigger).start()
