"""Publication: what becomes of each delivery of a turn, in the order of delivery."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.contracts import error_name, with_defaults
from strandline.functions.identity import DEFAULT, Formats, episode_id, layout_path, payload_digest, rendered
from strandline.sources import corpus
from strandline.sources.folders import checkpointed

from . import verify

COVERED = ("world", "scope", "lane", "harness", "session_id", "turn_id", "event_time_ms", "capture_policy", "turn_outcome", "user_content")


def prepared(payloads: DataFrame, formats: Formats = DEFAULT) -> DataFrame:
    """Payloads with defaults, ``error`` (null if valid), episode_id, payload_digest and rel_path."""
    valid = with_defaults(payloads).withColumn("error", error_name())
    return valid.withColumn("episode_id", episode_id(formats=formats)).withColumn("payload_digest", payload_digest(formats)).withColumn("rel_path", layout_path())


class Turn:
    """What is stored of a turn, and what a further delivery of it amounts to."""

    def __init__(self):
        self.digest: str | None = None
        self.covered: tuple = ()
        self.result, self.tools = "", []

    def deliver(self, digest: str, covered: tuple, result: str, tools: list[str]) -> str:
        """published, duplicate, superseded (a strict extension replaces what is stored) or conflict.

        The digest comes first: what was edited since, but says that it is this revision, is a duplicate.
        """
        if self.digest is None:
            outcome = "published"
        elif digest == self.digest:
            outcome = "duplicate"
        elif covered == self.covered and len(result) > len(self.result) and result.startswith(self.result) and tools[: len(self.tools)] == self.tools:
            outcome = "superseded"
        else:
            outcome = "conflict"
        if outcome in ("published", "superseded"):
            self.digest, self.covered, self.result, self.tools = digest, covered, result, tools
        return outcome


def recorded(verified: DataFrame) -> DataFrame:
    """What a corpus holds of turns: ``verify.verified`` records as (episode_id, digest, covered, result, tools).

    Of copies the first in walk order counts. A record that was edited since, or lies elsewhere than its
    fields say, has no ``covered``: only its own revision is a duplicate of it, and nothing extends it.
    """
    sound = (F.col("verify_status") == "ok") & (F.col("rel_path") == layout_path())
    place = Window.partitionBy("episode_id").orderBy(F.split("rel_path", "/"))
    return (
        verified.filter("parses")
        .withColumn("copy_", F.row_number().over(place))
        .filter("copy_ = 1")
        .select("episode_id", F.col("recorded_digest").alias("payload_digest"), F.when(sound, F.to_json(F.struct(*COVERED))).alias("covered"), "assistant_result", "tools")
    )


def outcomes(deliveries: DataFrame, order: str = "seq", known: DataFrame | None = None) -> DataFrame:
    """(order, episode_id, payload_digest, outcome) of ``prepared`` deliveries; invalid ones are ``malformed``.

    ``known`` is what the corpus holds (``recorded``): it stands before every delivery of its turn. Rows
    of a turn come to one task in order and are read one by one: only the stored delivery is held,
    however many there are.
    """
    kind = deliveries.schema[order].dataType.simpleString()
    bad = deliveries.filter(F.col("error").isNotNull()).select(order, "episode_id", "payload_digest", F.lit("malformed").alias("outcome"))
    tools = F.coalesce("tools", F.array().cast("array<string>")).alias("tools")
    good = deliveries.filter(F.col("error").isNull()).select(order, "episode_id", "payload_digest", F.to_json(F.struct(*COVERED)).alias("covered"), "assistant_result", tools, F.lit(True).alias("new_"))
    if known is not None:
        there = known.join(good.select("episode_id").distinct(), "episode_id", "left_semi")
        there = there.select(F.lit(None).cast(kind).alias(order), "episode_id", "payload_digest", "covered", "assistant_result", tools, F.lit(False).alias("new_"))
        good = good.unionByName(there)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, turn = None, Turn()
        for batch in batches:
            out = []
            for e, digest, covered, result, tools, new in zip(*(batch.column(i).to_pylist() for i in range(1, 7))):
                if e != name:
                    name, turn = e, Turn()
                if new:
                    out.append(turn.deliver(digest, (covered,), result, tools))
                else:
                    turn.digest, turn.covered, turn.result, turn.tools = digest, (covered,), result or "", tools
            kept = [batch.column(i).filter(batch.column(6)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.string())], names=[order, "episode_id", "payload_digest", "outcome"])

    # False comes before true, so what is known comes first.
    dealt = good.repartition("episode_id").sortWithinPartitions("episode_id", "new_", order)
    done = dealt.mapInArrow(run, f"{order} {kind}, episode_id string, payload_digest string, outcome string")
    return done.unionByName(bad)


def stored(deliveries: DataFrame, decided: DataFrame, order: str = "seq") -> DataFrame:
    """The delivery that stands for each turn: the last that was published or superseded."""
    last = decided.filter(F.col("outcome").isin("published", "superseded")).groupBy("episode_id").agg(F.max(order).alias(order))
    return deliveries.join(last, ["episode_id", order], "left_semi")


def capture(payloads: DataFrame, files: DataFrame | None, root: str, now_ms: int, order: str = "seq", formats: Formats = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Take deliveries into the corpus at ``root`` in their order, and give ``outcomes`` and what was written.

    ``files`` (rel_path, content) are the records that the corpus holds. The steps are, in this order:
    defaults, checks, refusal of a folder into which others may write, deliveries of turns that the corpus
    knows, publication of what stands at the end. A delivery that extends a stored record replaces it.
    """
    if corpus.in_shared_directory(root):
        raise PermissionError(f"others may write where {root} lies")
    ready = prepared(payloads, formats).withColumn("capture_time_ms", F.lit(now_ms))
    if "malformed" in payloads.columns:
        ready = ready.withColumn("error", F.when(F.col("malformed"), "MalformedPayload").otherwise(F.col("error")))
    known = None if files is None else recorded(verify.verified(files, formats))
    decided = checkpointed(outcomes(ready, order, known))
    standing = stored(ready, decided, order).withColumn("content", rendered(formats))
    if known is not None:
        held = known.select("episode_id", F.lit(True).alias("replace"))
        standing = standing.join(held, "episode_id", "left")
    return decided, corpus.write(standing, root)
