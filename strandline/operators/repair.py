"""Records of an older projection set right by replaying their transcripts.

``replayed`` is the report, which writes nothing; ``Repair`` publishes what stands in for the records and then
takes those away of which the replacement was found standing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.identity import DEFAULT, Formats
from strandline.sources import corpus
from strandline.sources.folders import names_in

from . import capture, verify
from .store import Store
from .transcripts import completed_turns

PLACE = ("world", "scope", "lane", "harness", "session_id", "turn_id")


def outdated(files: DataFrame, formats: Formats = DEFAULT) -> DataFrame:
    """Files (rel_path, content) as ``replayed`` takes them: what the headers say, also such as lack a line, and the files' hashes."""
    r = verify.parsed(files, formats)
    more = {n: verify.header_value("content", n) for n in ("workspace_root", "host")}
    usual = {n: F.coalesce(n, F.lit(v)) for n, v in (("world", "main"), ("scope", "default"), ("lane", "conversation"))}
    return r.withColumns(more | usual | {"file_hash": F.sha2(F.col("content").cast("binary"), 256)}).drop("content", "body")


def anchors(found: DataFrame) -> DataFrame:
    """(session, turn_id, turn): to which turn each of a transcript's ``entries`` belongs, null before the first one."""
    by = Window.partitionBy("session").orderBy("line_no")
    starts = F.col("kind").isin("owner", "envelope")
    placed = found.withColumn("index", F.row_number().over(by) - 1).withColumn("turn", F.nullif(F.sum(starts.cast("long")).over(by), F.lit(0)))
    named = placed.withColumn("turn_id", F.coalesce("uuid", F.concat(F.lit("idx"), F.col("index").cast("string"))))
    # Of entries that share a name the first counts.
    return named.groupBy("session", "turn_id").agg(F.min_by("turn", "index").alias("turn"))


def replayed(records: DataFrame, found: DataFrame, old_policy: str) -> DataFrame:
    """What becomes of each record of ``old_policy``, as a report; nothing is written.

    A record that was anchored on an entry that no one typed goes to the turn of the nearest typed entry
    before it. ``action`` is replace, no_transcript, not_publishable or incomplete (the header lacks session,
    turn or time); several records may give one and the same replacement. Time falls back to the record's own.
    """
    more = [c for c in ("workspace_root", "host", "file_hash") if c in records.columns]
    old = records.filter(F.col("capture_policy") == old_policy).select("episode_id", "rel_path", "session_id", F.col("turn_id").alias("old_turn_id"), F.col("event_time_ms").alias("old_time_ms"), "world", "scope", "lane", "harness", *more)
    sessions = found.select(F.col("session").alias("session_id")).distinct().withColumn("has_transcript", F.lit(True))
    at = anchors(found).select(F.col("session").alias("session_id"), F.col("turn_id").alias("old_turn_id"), "turn")
    turns = completed_turns(found).withColumnRenamed("session", "session_id")
    out = old.join(sessions, "session_id", "left").join(at, ["session_id", "old_turn_id"], "left").join(turns, ["session_id", "turn"], "left")
    lacks = F.col("session_id").isNull() | F.col("old_turn_id").isNull() | F.col("old_time_ms").isNull()
    action = F.when(lacks, "incomplete").when(F.col("has_transcript").isNull(), "no_transcript").when(F.col("turn_id").isNull(), "not_publishable").otherwise("replace")
    return out.select(
        "episode_id", "rel_path", "session_id", "old_turn_id", "world", "scope", "lane", "harness", action.alias("action"), "turn_id",
        (F.col("turn_id") != F.col("old_turn_id")).alias("reanchored"), F.coalesce("event_time_ms", F.when(F.col("turn_id").isNotNull(), F.col("old_time_ms"))).alias("event_time_ms"),
        "user_content", "assistant_result", F.slice("tools", 1, 256).alias("tools"), *more,
    )


def replacements(report: DataFrame) -> DataFrame:
    """One payload part for each replaced turn, and the records that it stands for.

    Workspace and host are those of the first record in the order of paths; that path is ``seq``.
    """
    more = [F.min_by(c, "rel_path").alias(c) for c in ("workspace_root", "host") if c in report.columns]
    return report.filter("action = 'replace'").groupBy(*PLACE).agg(
        *[F.first(c).alias(c) for c in ("user_content", "assistant_result", "tools")], F.min("event_time_ms").alias("event_time_ms"), F.array_sort(F.collect_set("episode_id")).alias("replaces"), F.min("rel_path").alias("seq"), *more
    )


class Repair:
    """A repair of one corpus in two steps, each of which may break off anywhere and be called again.

    ``ledger`` is a folder that tells what was planned and what was taken away. The plan is written once, so a
    second run has the records of the first one, whatever became of them. A record goes only if, when it is
    its turn, the replacement's file is read and verifies as the planned revision, and the record's own file
    still is what the plan saw. What a run before took away counts as taken away.
    """

    def __init__(self, spark: SparkSession, root: str, ledger: str, formats: Formats = DEFAULT):
        self.spark, self.root, self.ledger, self.formats = spark, root, ledger.rstrip("/"), formats

    def _has(self, name: str) -> bool:
        return "_SUCCESS" in names_in(self.spark, f"{self.ledger}/{name}")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.ledger}/{name}")

    def _files(self, paths: DataFrame) -> DataFrame:
        return corpus.contents_at(self.root)(paths).withColumn("content", F.col("content").cast("string"))

    def plan(self, files: DataFrame, found: DataFrame, old_policy: str, new_policy: str, adapter_version: str) -> DataFrame:
        """Write, once, what becomes of each of ``files`` of the old policy, by the ``entries`` of the transcripts.

        Gives (rel_path, episode_id, file_hash, action, reanchored, new_id, new_path). New records lie beside the old ones:
        world, scope, lane, workspace and host stay.
        """
        if old_policy == new_policy:
            raise ValueError("a repaired record must have another policy, as its id must differ")
        if not self._has("records"):
            # Texts are written once, with the report; what follows reads single columns of it.
            if not self._has("report"):
                replayed(outdated(files, self.formats), found, old_policy).write.mode("overwrite").parquet(f"{self.ledger}/report")
            report = self._read("report")
            fixed = {"schema_version": F.lit(1).cast("long"), "adapter_version": F.lit(adapter_version), "capture_policy": F.lit(new_policy), "turn_outcome": F.lit("completed"), "branch_of": F.lit(None).cast("string")}
            new = capture.prepared(replacements(report).withColumns(fixed), self.formats)
            new.write.mode("overwrite").parquet(f"{self.ledger}/payloads")
            at = self._read("payloads").select(*PLACE, F.col("episode_id").alias("new_id"), F.col("rel_path").alias("new_path"))
            old = report.join(at, list(PLACE), "left").select("rel_path", "episode_id", "file_hash", "action", "reanchored", "new_id", "new_path")
            old.write.mode("overwrite").parquet(f"{self.ledger}/records")
        return self._read("records")

    def publish(self, now_ms: int) -> DataFrame:
        """Publish the planned replacements as captures, and give their outcomes; nothing is taken away.

        Of two replacements with one id (a turn in two lanes, say) the first by path is published.
        """
        new = self._read("payloads")
        return capture.capture(new.drop("error", "episode_id", "payload_digest", "rel_path", "replaces"), self._files(new.select("rel_path").distinct()), self.root, now_ms, formats=self.formats)[0]

    def standing(self) -> DataFrame:
        """Paths of the planned replacements that are there now, as the planned revisions."""
        new = self._read("payloads")
        there = verify.verified(self._files(new.select("rel_path").distinct()), self.formats).filter("verify_status = 'ok'")
        there = there.select("rel_path", "episode_id", F.col("recorded_digest").alias("payload_digest"))
        return new.join(there, ["rel_path", "episode_id", "payload_digest"], "left_semi").select("rel_path").distinct()

    def remove(self) -> DataFrame:
        """Take away the records whose replacements stand, and give (rel_path, outcome) of each: deleted, gone or changed."""
        if not self._has("removed"):
            stands = self.standing()
            old = self._read("records").filter("action = 'replace'").join(stands.withColumnRenamed("rel_path", "new_path"), "new_path", "left_semi")
            # A path on which a replacement lies is no old record any more.
            old = old.join(self._read("payloads").select("rel_path"), "rel_path", "left_anti")
            corpus.remove(old.select("rel_path", "file_hash"), self.root).write.mode("overwrite").parquet(f"{self.ledger}/removed")
        return self._read("removed")

    def records(self) -> DataFrame:
        """The plan with what became of each record: replaced, kept, or null where nothing was to be done or is done yet."""
        planned = self._read("records")
        if not self._has("removed"):
            return planned.withColumn("result", F.lit(None).cast("string"))
        went = self._read("removed").filter("outcome <> 'changed'").select("rel_path", F.lit(True).alias("went_"))
        result = F.when(F.col("action") == "replace", F.when(F.col("went_"), "replaced").otherwise("kept"))
        return planned.join(went, "rel_path", "left").withColumn("result", result).drop("went_")

    def account(self) -> DataFrame:
        """The account of a repair in one row, the same for every run of it."""
        is_ = lambda *names: F.count_if(F.col("action").isin(*names))
        replaced = F.count_if(F.coalesce(F.col("result") == "replaced", F.lit(False)))
        return self.records().agg(
            F.count("*").alias("found"), is_("replace", "not_publishable").alias("transcript_located"),
            F.count_if((F.col("action") == "replace") & F.col("reanchored")).alias("reanchored"),
            is_("replace").alias("would_publish"), is_("replace").alias("would_delete"), replaced.alias("published"), replaced.alias("deleted"),
            is_("not_publishable").alias("not_publishable"), is_("no_transcript", "incomplete").alias("unrepairable"),
            F.count_if(F.coalesce(F.col("result") == "kept", F.lit(False))).alias("kept"),
        )

    def run(self, files: DataFrame, found: DataFrame, old_policy: str, new_policy: str, adapter_version: str, now_ms: int, store: Store | None = None) -> DataFrame:
        """Plan, publish, remove, bring the projection up to date, and give the account."""
        self.plan(files, found, old_policy, new_policy, adapter_version)
        if not self._has("removed"):
            self.publish(now_ms)
            self.remove()
        if store is not None:
            now = corpus.read(self.spark, self.root).filter("kind = 'episode'").select("rel_path", F.col("content").cast("string").alias("content"))
            store.sync(now, derive=lambda some: verify.verified(some, self.formats))
        return self.account()
