"""A projection of a corpus kept as Parquet, in immutable segments under numbered snapshots.

Every sync writes a segment of each table that it changes and then, as its last step, one snapshot that
says which segments count. A reader keeps the snapshot that it opened, and a sync that breaks off changes
nothing that anyone reads. Two tables are kept by replacing whole parts: ``files`` (every file's path, hash
and what it holds, by hash of the path) and ``episodes`` (the first copy of each record, by hash of the id).
The others only grow: ``texts`` (by id), ``postings`` (by term), ``terms`` (changes of document frequencies,
which add up) and ``trigrams`` (of terms that came, or, with -1, that went). A text or posting counts if its
record still is of that segment; of a segment that has lost none, which the snapshot says, all rows count.
``compact`` writes what counts anew, ``vacuum`` removes what no kept snapshot names.

Postings take several times the corpus while they are shuffled, so they are written, texts gathered and all
tables compacted some parts at a time, and a job's shuffles go as it ends.

Whether a part of the corpus has changed is told by a sum of hashes over its paths and files, without a join.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.text import MAX_VOCABULARY, MIN_NEEDLE, trigrams
from strandline.sources.folders import bytes_in, checkpointed, delete, names_in, put_new, read_text, shuffles_released, spread

from . import projection, retrieval

FOUND = "rel_path string, file_hash string, episode_id string, world string, scope string, lane string, event_time_ms long, body_line int, recorded_digest string, verify_status string"
TABLES = {
    "files": f"{FOUND}, parses boolean",
    "episodes": f"{FOUND}, since string",
    "texts": "episode_id string, world string, lane string, body_line int, content string",
    "postings": "world string, term string, lane string, episode_id string, line_no int",
    "terms": "world string, term string, df long, eval_df long",
    "trigrams": "world string, trigram string, term string, live int",
}
ORDER = {"files": ["rel_path"], "episodes": ["episode_id"], "texts": ["episode_id"], "postings": ["world", "term"], "terms": ["world", "term"], "trigrams": ["world", "trigram", "term"]}
REPLACED, GROWING = ("files", "episodes"), ("texts", "postings", "terms", "trigrams")
VERSION, PARTS, KEPT, MOST_SEGMENTS = 2, 8, 4, 16
#: Bytes of Parquet that are shuffled at a time, or one part if that is larger.
BATCH = 16 << 20
#: Of sorted strings the second version's encoding keeps what differs from the one before.
PACKED = {"compression": "zstd", "parquet.writer.version": "v2"}


def part_of(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def parts_of(keys, parts: int) -> list[int]:
    """The same for texts on the driver."""
    from xxhash import xxh64_intdigest

    signed = [h - (h >> 63 << 64) for h in (xxh64_intdigest(k.encode(), 42) for k in keys)]
    return sorted({h % parts for h in signed})


def sums(files: DataFrame, parts: int) -> dict[str, list[int]]:
    """By part: number of (rel_path, file_hash and any further columns), and two sums of their hashes, in any order."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in files.columns if c != "part"]
    of = lambda seed: F.sum(F.xxhash64(F.lit(seed), *told).cast("decimal(38,0)"))
    rows = files.groupBy(part_of(F.col("rel_path"), parts).alias("part")).agg(F.count("*").alias("n"), of(1).alias("a"), of(2).alias("b")).collect()
    return {str(r["part"]): [r["n"], int(r["a"]), int(r["b"])] for r in rows}


def releasing(method):
    """A method of the store whose jobs leave no shuffles behind."""

    @wraps(method)
    def run(self, *args, **kwargs):
        with shuffles_released(self.spark):
            return method(self, *args, **kwargs)

    return run


class Store:
    """The projection under one folder of any file system that Spark reaches, as of the snapshot that was opened."""

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS, kept: int = KEPT):
        self.spark, self.root, self.parts, self.kept = spark, root.rstrip("/"), parts, kept
        self.refresh()

    def _numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.root}/snapshots") if n.endswith(".json") and not n.startswith(".")]

    def _snapshot(self, number: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.root}/snapshots/{number:012d}.json"))

    def refresh(self) -> None:
        """Go on with the latest snapshot. One of another version is given up with all that belongs to it."""
        numbers = self._numbers()
        self.snapshot = self._snapshot(numbers[-1]) if numbers else None
        if self.snapshot and self.snapshot["version"] != VERSION:
            self.dispose()

    def dispose(self) -> None:
        """Remove everything; the next sync builds it anew."""
        for name in ("snapshots", *TABLES):
            delete(self.spark, f"{self.root}/{name}")
        self.snapshot = None

    def meta(self) -> dict | None:
        """What the last sync noted: the format's version and its counters."""
        return self.snapshot and {n: self.snapshot[n] for n in ("version", "unreadable", "skipped", "duplicates", "mismatched", "files_seen", "latest_ms")}

    def _scan(self, name: str, parts: list[int] | None = None, segments: list[str] | None = None) -> DataFrame:
        """A table's segments of this snapshot, or some of them or of their parts; ``seg`` and ``part`` say where a row lies."""
        schema, here = f"{TABLES[name]}, seg string, part int", f"{self.root}/{name}"
        told = self.snapshot["tables"][name] if self.snapshot else {}
        paths = [f"{here}/seg={seg}/part={p}" for seg, ps in told.items() if segments is None or seg in segments for p in ps if parts is None or p in parts]
        return self.spark.read.schema(schema).option("basePath", here).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """The rows of a table that count, or those in some parts."""
        if name in ("texts", "postings"):
            return self._current(name, parts).drop("seg", "part")
        if name == "terms":
            return self.statistics(parts=parts)
        rows = self._scan(name, parts)
        if name == "trigrams":
            return rows.groupBy("world", "trigram", "term").agg(F.sum("live").alias("live")).filter("live > 0").drop("live")
        return rows.drop("seg", "part")

    def _current(self, name: str, parts: list[int] | None) -> DataFrame:
        """Rows of records that are still of their segment. Only rows of segments that lost some are held against the records."""
        told, whole = self.snapshot["tables"][name] if self.snapshot else {}, self.snapshot.get("whole", []) if self.snapshot else []
        torn = [s for s in told if s not in whole]
        rows = self._scan(name, parts, whole)
        if not torn:
            return rows
        # Texts lie by the records' ids, as the records do.
        held = self._scan("episodes", parts if name == "texts" else None).select("episode_id", F.col("since").alias("seg")).filter(F.col("seg").isin(torn))
        some = self._scan(name, parts, torn).join(held, ["episode_id", "seg"], "left_semi")
        return rows.unionByName(some) if len(torn) < len(told) else some

    def _batches(self, name: str) -> list[list[int]]:
        """A table's parts, as many together as have ``BATCH`` bytes."""
        told, out, held = self.snapshot["tables"][name], [], 0
        for p in sorted({p for ps in told.values() for p in ps}):
            size = sum(bytes_in(self.spark, f"{self.root}/{name}/seg={s}/part={p}") for s, ps in told.items() if p in ps)
            if not out or held + size > BATCH:
                out, held = [*out, []], 0
            out[-1].append(p)
            held += size
        return out

    def _write(self, name: str, rows: DataFrame, segment: str, by: Column, gathered: bool = True) -> list[int]:
        """Write a segment of a table, or more of it, dealt by a hash, and give the parts that have rows. Large parts are split over tasks by size.

        Without ``gathered`` each task writes what it has of every part: no shuffle, but more files.
        """
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        dealt = rows.withColumn("part", by).select(*columns, "part")
        dealt = (dealt.hint("rebalance", "part") if gathered else dealt).sortWithinPartitions("part", *ORDER[name])
        path = f"{self.root}/{name}/seg={segment}"
        dealt.write.mode("append").options(**PACKED).partitionBy("part").parquet(path)
        return sorted(int(n.removeprefix("part=")) for n in names_in(self.spark, path) if n.startswith("part="))

    def _at(self, tables: dict) -> Store:
        """A reader of segments that aren't in a snapshot yet."""
        other = Store.__new__(Store)
        other.spark, other.root, other.snapshot = self.spark, self.root, {"tables": tables}
        return other

    def _commit(self, snapshot: dict) -> None:
        if not put_new(self.spark, f"{self.root}/snapshots/{snapshot['number']:012d}.json", json.dumps(snapshot)):
            raise RuntimeError("another sync was first")
        self.snapshot = snapshot
        self.vacuum()

    @releasing
    def sync(self, records: DataFrame, unreadable: int = 0, signature: tuple[int, int] | None = None, derive=None) -> dict:
        """Bring the projection up to date with ``records`` and say what was done, in seven counters.

        Records have rel_path and content, and what ``verify.verified`` gives of them: episode_id, world, scope,
        lane, event_time_ms, body_line, parses and verify_status. With ``derive`` they are bare files, and it
        adds those columns to the ones that changed. Files that don't parse are skipped; of records that
        share an id the first in walk order is kept. Records whose digest doesn't hold are kept, too, and left
        out of searches. ``signature`` (number of files, time of the latest change) is that of the corpus
        before it was read.
        """
        self.refresh()
        old = self.snapshot or {"number": 0, "parts": self.parts, "tables": {n: {} for n in TABLES}, "sums": {}, "worlds": {}, "episodes": 0, "skipped": 0, "duplicates": 0, "mismatched": 0}
        parts, told = old["parts"], [] if derive else ["parses", "verify_status"]
        new = old | {"version": VERSION, "number": old["number"] + 1, "unreadable": unreadable, "files_seen": (signature or (None,))[0], "latest_ms": (signature or (None, None))[1]}
        hashed = records.withColumn("file_hash", F.sha2(F.col("content").cast("binary"), 256))
        slim = [c.split()[0] for c in TABLES["files"].split(", ")]
        full = (derive or (lambda r: r))(hashed)
        if "recorded_digest" not in full.columns:
            full = full.withColumn("recorded_digest", F.lit(None).cast("string"))
        indexed = removed = 0
        if self.snapshot is None:
            came = checkpointed(full.select(*slim))
            new["sums"], changed = sums(came.select("rel_path", "file_hash", *told), parts), list(range(parts))
            gone = came.select("rel_path", "episode_id").limit(0)
        else:
            seen = hashed.select("rel_path", "file_hash", *told)
            new["sums"] = sums(seen, parts)
            changed = [p for p in range(parts) if new["sums"].get(str(p)) != old["sums"].get(str(p))]
        if changed or self.snapshot is None:
            if self.snapshot is not None:
                before = self._scan("files", changed).select("rel_path", "episode_id", *[F.col(c).alias(f"{c}_") for c in ("file_hash", *told)])
                both = seen.filter(part_of(F.col("rel_path"), parts).isin(changed)).join(before, "rel_path", "full_outer")
                same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("file_hash", *told)])
                differ = checkpointed(both.filter(~same).select("rel_path", "episode_id", F.col("file_hash").isNotNull().alias("there"), F.col("file_hash_").isNotNull().alias("before")))
                todo, gone = differ.filter("there").select("rel_path"), differ.filter("before").select("rel_path", "episode_id")
                some = hashed.join(todo, "rel_path", "left_semi")
                came = derive(some) if derive else some
                came = came if "recorded_digest" in came.columns else came.withColumn("recorded_digest", F.lit(None).cast("string"))
                came = checkpointed(came.select(*slim))
            indexed, removed = self._change(new, hashed, came, gone, changed)
        report = {"indexed": indexed, "unchanged": new["episodes"] - indexed, "removed": removed, "skipped_malformed": new["skipped"], "duplicate_ids": new["duplicates"], "digest_mismatch": new["mismatched"], "unreadable": unreadable}
        noted = ("unreadable", "files_seen", "latest_ms")
        if changed or self.snapshot is None or any(new[n] != old[n] for n in noted):
            self._commit(new)
        return report

    @releasing
    def upsert(self, files: DataFrame, derive) -> dict:
        """Take in (rel_path, content) of files that came or changed, without a look at any other: indexed and unchanged files.

        What was noted of the rest of the corpus still holds. Equal files change nothing, so it can be done again.
        """
        self.refresh()
        if self.snapshot is None:
            report = self.sync(files, derive=derive)
            return {"indexed": report["indexed"], "unchanged": report["unchanged"]}
        old, parts = self.snapshot, self.snapshot["parts"]
        hashed = files.withColumn("file_hash", F.sha2(F.col("content").cast("binary"), 256))
        given = checkpointed(hashed.select("rel_path", "file_hash"))
        changed = [r[0] for r in given.select(part_of(F.col("rel_path"), parts)).distinct().collect()]
        before = self._scan("files", changed).select("rel_path", "episode_id", F.col("file_hash").alias("hash_")).join(given, "rel_path")
        before = checkpointed(before.select("rel_path", "episode_id", F.col("hash_").alias("file_hash"), (F.col("hash_") == F.col("file_hash")).alias("same")))
        todo = given.join(before.filter("same").select("rel_path"), "rel_path", "left_anti").select("rel_path")
        came = derive(hashed.join(todo, "rel_path", "left_semi"))
        came = came if "recorded_digest" in came.columns else came.withColumn("recorded_digest", F.lit(None).cast("string"))
        came = checkpointed(came.select(*[c.split()[0] for c in TABLES["files"].split(", ")]))
        gone = before.filter("NOT same")
        plus, minus = sums(came.select("rel_path", "file_hash"), parts), sums(gone.select("rel_path", "file_hash"), parts)
        indexed = 0
        if plus:
            new = old | {"number": old["number"] + 1, "sums": dict(old["sums"]), "files_seen": None, "latest_ms": None}
            for p, more in plus.items():
                new["sums"][p] = [x + y - z for x, y, z in zip(new["sums"].get(p, [0, 0, 0]), more, minus.get(p, [0, 0, 0]))]
            indexed, _ = self._change(new, hashed, came, gone.select("rel_path", "episode_id"), sorted(map(int, plus)))
            self._commit(new)
        return {"indexed": indexed, "unchanged": given.count() - indexed}

    def _change(self, new: dict, hashed: DataFrame, came: DataFrame, gone: DataFrame, changed: list[int]) -> tuple[int, int]:
        """Write the segments of a sync into ``new``: files that came (with what they hold) and paths that went or had other content."""
        first, parts, segment = self.snapshot is None, new["parts"], f"{new['number']:012d}-{uuid.uuid4().hex[:8]}"
        by_id, by_path, by_term = (part_of(F.col(c), parts) for c in ("episode_id", "rel_path", "term"))
        tables = new["tables"] = {n: {s: list(p) for s, p in t.items()} for n, t in new["tables"].items()}

        def replace(name: str, rows: DataFrame, which: list[int]) -> None:
            made = self._write(name, rows, segment, by_path if name == "files" else by_id)
            kept = {s: [p for p in ps if p not in which] for s, ps in tables[name].items()}
            tables[name] = {s: ps for s, ps in (kept | {segment: made}).items() if ps}

        def grow(name: str, rows: DataFrame, by: Column) -> None:
            if made := self._write(name, rows, segment, by):
                tables[name][segment] = made

        columns = [c for c in came.columns]
        stay = self._scan("files", changed).select(*columns).join(gone.select("rel_path"), "rel_path", "left_anti")
        replace("files", stay.unionByName(came) if not first else came, changed)
        others = self._scan("files", [p for p in range(parts) if p not in changed]).select(*columns)
        copies = came if first else others.unionByName(stay).unionByName(came)
        if not first:
            ids = checkpointed(came.filter("parses").select("episode_id").unionByName(gone.select("episode_id")).filter("episode_id IS NOT NULL").distinct())
        walk = Window.partitionBy("episode_id").orderBy(F.split("rel_path", "/"))
        now = copies.filter("parses")
        now = (now if first else now.join(ids, "episode_id", "left_semi")).withColumn("copy", F.row_number().over(walk)).filter("copy = 1").drop("copy", "parses")
        then = self._scan("episodes").select("episode_id", F.col("rel_path").alias("path_"), F.col("file_hash").alias("hash_"), F.col("since").alias("since_"))
        both = now.join(then if first else then.join(ids, "episode_id", "left_semi"), "episode_id", "full_outer")
        fresh = F.col("rel_path").isNotNull() & ~((F.col("rel_path").eqNullSafe(F.col("path_"))) & (F.col("file_hash").eqNullSafe(F.col("hash_"))))
        both = checkpointed(both.withColumn("fresh", fresh))
        counts = both.agg(F.count_if("fresh"), F.count_if(F.col("rel_path").isNull()), F.count_if(F.col("since_").isNull()), F.collect_set(by_id), F.collect_set(F.when(F.col("fresh") | F.col("rel_path").isNull(), F.col("since_")))).first()
        indexed, removed = counts[0], counts[1]
        new["whole"] = [s for s in [*new.get("whole", []), segment] if s not in counts[4]]
        row = both.filter("rel_path IS NOT NULL").withColumn("since", F.when(F.col("fresh"), F.lit(segment)).otherwise(F.col("since_")))
        row = row.drop("path_", "hash_", "since_", "fresh")
        if not first:
            row = self._scan("episodes", counts[3]).drop("seg", "part").join(ids, "episode_id", "left_anti").unionByName(row)
        replace("episodes", row, counts[3])

        change, posted = self.spark.createDataFrame([], TABLES["terms"]), None
        if indexed:
            # All texts are shuffled by path here. Not to shuffle them by id in the same job, what is kept is written as it comes, and gathered some parts at a time.
            loose = f"{segment}-loose"
            some_texts = hashed.select("rel_path", "content").join(both.filter("fresh").select("rel_path", "episode_id", "world", "lane", "body_line"), "rel_path")
            as_came = self._at({"texts": {loose: self._write("texts", some_texts, loose, by_id, gathered=False)}})
            for some in as_came._batches("texts"):
                grow("texts", as_came._scan("texts", some), by_id)
            delete(self.spark, f"{self.root}/texts/seg={loose}")
            fresh_texts = self._at({"texts": {segment: tables["texts"][segment]}})

            def post() -> None:
                for some in fresh_texts._batches("texts"):
                    grow("postings", projection.postings(spread(fresh_texts._scan("texts", some))), by_term)

            # Postings don't wait for what becomes of frequencies.
            pool = ThreadPoolExecutor(1)
            posted = pool.submit(post)
            change = projection.term_stats_of(fresh_texts._scan("texts"))
        # What replaced and removed records had is counted out.
        was = both.filter("since_ IS NOT NULL AND (fresh OR rel_path IS NULL)").select("episode_id", F.col("since_").alias("seg"), by_id.alias("part"))
        if not first and counts[2] < indexed + removed:
            lost = projection.term_stats_of(self._scan("texts", counts[3]).join(was, ["part", "episode_id", "seg"], "left_semi"))
            change = change.unionByName(lost.select("world", "term", (-F.col("df")).alias("df"), (-F.col("eval_df")).alias("eval_df")))
            change = change.groupBy("world", "term").agg(F.sum("df").alias("df"), F.sum("eval_df").alias("eval_df")).filter("df <> 0 OR eval_df <> 0")
        if first:
            grow("terms", change, by_term)
            moved = self._at({"terms": tables["terms"]})._scan("terms").withColumn("live", F.lit(1)) if tables["terms"] else None
        else:
            change = checkpointed(change)
            grow("terms", change, by_term)
            held = self._scan("terms").join(change.select("world", "term"), ["world", "term"], "left_semi").groupBy("world", "term").agg(F.sum(F.col("df") + F.col("eval_df")).alias("held"))
            after = change.join(held, ["world", "term"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
            here = (F.col("held") + F.col("df") + F.col("eval_df") > 0).cast("int") - (F.col("held") > 0).cast("int")
            moved = after.withColumn("live", here).filter("live <> 0")
        if moved is not None:
            grow("trigrams", moved.select("world", "term", F.explode(trigrams(F.col("term"))).alias("trigram"), "live"), part_of(F.col("trigram"), parts))
        if posted is not None:
            posted.result()
        mine = self._at(tables)
        ready = F.count_if((F.col("lane") != "evaluation") & (F.col("verify_status") == "ok"))
        by_world = mine._scan("episodes").groupBy("world").agg(F.count("*").alias("episodes"), ready.alias("n")).collect()
        found = mine._scan("files").agg(F.count_if(~F.col("parses")), F.count_if(F.col("verify_status") == "digest_mismatch"), F.count_if("parses")).first()
        new["worlds"], new["episodes"] = {r["world"]: r["n"] for r in by_world}, sum(r["episodes"] for r in by_world)
        new["skipped"], new["mismatched"], new["duplicates"] = found[0], found[1], found[2] - new["episodes"]
        return indexed, removed

    @releasing
    def compact(self) -> None:
        """Write what counts as one segment of each growing table, some parts at a time."""
        self.refresh()
        if self.snapshot is None:
            return
        new, segment, parts = dict(self.snapshot), f"{self.snapshot['number'] + 1:012d}-{uuid.uuid4().hex[:8]}", self.snapshot["parts"]
        new["number"] += 1
        # What takes the most while it is written goes first, when the least lies there twice.
        key, made = {"postings": "term", "texts": "episode_id", "trigrams": "trigram", "terms": "term"}, dict.fromkeys(GROWING, [])
        for name, by in key.items():
            for some in self._batches(name):
                rows = self.read(name, some)
                made[name] = self._write(name, rows.withColumn("live", F.lit(1)) if name == "trigrams" else rows, segment, part_of(F.col(by), parts))
        made["episodes"] = self._write("episodes", self.read("episodes").withColumn("since", F.lit(segment)), segment, part_of(F.col("episode_id"), parts))
        new["tables"], new["whole"] = new["tables"] | {n: {segment: ps} if ps else {} for n, ps in made.items()}, [segment]
        self._commit(new)

    def vacuum(self) -> None:
        """Remove snapshots but the latest ``kept``, and segments that none of these names. What a running sync has written stays, as it is younger."""
        numbers = self._numbers()
        if len(numbers) <= self.kept:
            return
        kept = [self._snapshot(n) for n in numbers[-self.kept :]]
        for name in TABLES:
            named = {s for k in kept for s in k["tables"][name]}
            for folder in names_in(self.spark, f"{self.root}/{name}"):
                segment = folder.removeprefix("seg=")
                if segment not in named and int(segment.split("-")[0]) <= numbers[-1]:
                    delete(self.spark, f"{self.root}/{name}/{folder}")
        for n in numbers[: -self.kept]:
            delete(self.spark, f"{self.root}/snapshots/{n:012d}.json")

    def holds(self, signature: tuple[int, int], now_ms: int) -> bool:
        """Whether the last sync's word still holds by the corpus's signature alone, so that no file has to be read.

        A corpus whose latest change isn't in the past could change again without its signature.
        """
        s = self.snapshot
        return s is not None and not s["unreadable"] and signature[1] < now_ms and tuple(signature) == (s["files_seen"], s["latest_ms"])

    def vocabulary(self, world: str) -> DataFrame:
        """The terms of a world, in order."""
        return self.statistics(world).select("term").orderBy("term")

    def statistics(self, world: str | None = None, parts: list[int] | None = None) -> DataFrame:
        """(world, term, df, eval_df) of all segments together, or of terms in some parts."""
        t = self._scan("terms", parts)
        t = t if world is None else t.filter(F.col("world") == world)
        return t.groupBy("world", "term").agg(F.sum("df").alias("df"), F.sum("eval_df").alias("eval_df")).filter("df > 0 OR eval_df > 0")

    def lookup(self, episode_id: str) -> dict | None:
        """The row of one record; only its part is read."""
        if self.snapshot is None:
            return None
        rows = self._scan("episodes", parts_of([episode_id], self.snapshot["parts"])).drop("seg", "part", "since")
        row = rows.filter(F.col("episode_id") == episode_id).first()
        return row and row.asDict()

    def stored_hashes(self) -> DataFrame:
        return self._scan("episodes").select("rel_path", "file_hash")

    def terms_with(self, world: str, needles: list[str]) -> DataFrame:
        """The terms of a world that hold any needle: those with all of a needle's trigrams, then the needle itself.

        Only the parts with these trigrams are read. A needle that is too short for a trigram needs the vocabulary.
        """
        if any(len(n) < MIN_NEEDLE for n in needles):
            return self.statistics(world).filter(retrieval.has_needle(F.col("term"), needles)).select("term")
        grams = {n: sorted({n[i : i + MIN_NEEDLE] for i in range(len(n) - MIN_NEEDLE + 1)}) for n in needles}
        every = sorted({g for gs in grams.values() for g in gs})
        rows = self._scan("trigrams", parts_of(every, self.snapshot["parts"]) if self.snapshot else None).filter((F.col("world") == world) & F.col("trigram").isin(every))
        live = rows.groupBy("term", "trigram").agg(F.sum("live").alias("live")).filter("live > 0")
        held = live.groupBy("term").agg(F.collect_set("trigram").alias("held"))
        hit = F.lit(False)
        for n, gs in grams.items():
            hit = hit | ((F.size(F.array_intersect("held", F.array(*map(F.lit, gs)))) == len(gs)) & F.contains("term", F.lit(n)))
        return held.filter(hit).select("term")

    def candidates(self, world: str, needles: list[str], scope: str | None = None, lanes=retrieval.DEFAULT_LANES, sources=None) -> tuple[DataFrame, DataFrame, bool]:
        """Lines with a term that holds a needle, with their records' metadata, records that are left out, and whether more terms than the cap match.

        Postings are read in the parts of the matching terms alone, and texts in the parts of records that
        these name. ``sources`` gives the hashes (rel_path, file_hash) of the files at some paths (rel_path) as
        they are now; records whose file has another one, or isn't there, are left out.
        """
        known = [r[0] for r in self.terms_with(world, needles).orderBy("term").limit(MAX_VOCABULARY + 1).collect()]
        more, known = len(known) > MAX_VOCABULARY, known[:MAX_VOCABULARY]
        parts = self.snapshot["parts"] if self.snapshot else self.parts
        here = (F.col("world") == world) & F.col("lane").isin(list(lanes))
        pairs = self._scan("postings", parts_of(known, parts)).filter(here & F.col("term").isin(known)).select("episode_id", "line_no", "seg").distinct()
        pairs = pairs.withColumn("part", part_of(F.col("episode_id"), parts))
        meta = self._scan("episodes").drop("seg", "part").withColumnRenamed("since", "seg").filter(here if scope is None else here & (F.col("scope") == scope))
        asked = meta.join(pairs.select("episode_id", "seg").distinct(), ["episode_id", "seg"], "left_semi")
        if sources is not None:
            # A file whose record was edited isn't asked for: it is out already.
            asked = checkpointed(asked)
            now = sources(asked.filter("verify_status = 'ok'").select("rel_path"))
            held = asked.join(now.select("rel_path", F.col("file_hash").alias("hash_")), "rel_path", "left")
            state = F.when((F.col("verify_status") == "ok") & ~F.col("file_hash").eqNullSafe(F.col("hash_")), "edited").otherwise(F.col("verify_status"))
            asked = checkpointed(held.withColumn("verify_status", state).drop("hash_"))
        edited = asked.filter("verify_status <> 'ok'").select("episode_id")
        good = (asked if sources is not None else meta).filter("verify_status = 'ok'").drop("verify_status", "file_hash", "lane", "world")
        wanted = pairs.groupBy("part", "seg", "episode_id").agg(F.collect_list("line_no").alias("wanted"))
        texts = self._scan("texts").filter(F.col("world") == world).drop("world", "body_line").join(wanted, ["part", "seg", "episode_id"]).join(good, ["episode_id", "seg"])
        return projection.body_lines(texts).filter(F.array_contains("wanted", F.col("line_no"))).drop("wanted"), edited, more

    def search(self, query: str, world: str, now_ms: int, scope: str | None = None, lanes=retrieval.DEFAULT_LANES, aliases=None, knobs: retrieval.Knobs = retrieval.Knobs(), digits: int | None = None, sources=None) -> retrieval.Found | None:
        """``retrieval.search`` over the stored tables: the same ranking, without reading other texts.

        With ``sources`` candidates are held against their files first. The number of records in the world is
        the snapshot's.
        """
        p = retrieval.plan(query, aliases)
        if not p.base:
            return None
        lines, edited, more = self.candidates(world, p.needles, scope, lanes, sources)
        credited = lines.withColumn("mask", retrieval.matched_positions(F.col("line"), p.terms, knobs.mode)).filter(F.size("mask") > 0)
        n = self.snapshot["worlds"].get(world, 0) if self.snapshot else 0
        found = retrieval.rank(p, credited, n, now_ms, knobs, digits, more)
        found.edited = edited
        return found

    def with_snippets(self, rows: DataFrame, context: int = 3) -> DataFrame:
        """A page's rows with the lines around theirs, from the stored texts of these records."""
        ids = [tuple(r) for r in rows.select("part", "seg", "episode_id").distinct().collect()]  # of one page
        here = reduce(Column.__or__, [(F.col("part") == p) & (F.col("seg") == s) & (F.col("episode_id") == e) for p, s, e in ids], F.lit(False))
        texts = self._scan("texts", sorted({p for p, _, _ in ids})).filter(here).select("episode_id", "content", "body_line")
        return retrieval.with_snippets(rows.drop("body_line"), texts, context)


def hashes_of(files: DataFrame):
    """What ``sources`` of a search asks for, out of (rel_path, content)."""
    hashed = files.select("rel_path", F.sha2(F.col("content").cast("binary"), 256).alias("file_hash"))
    return lambda paths: hashed.join(paths, "rel_path", "left_semi")


def freshness(files: DataFrame, store: Store) -> dict:
    """How (rel_path, file_hash) of the corpus compare with what is stored, and whether searches see all of it.

    Equal sums in every part say that nothing changed; only where they differ is anything joined. Files that
    a sync left out on purpose (ill-formed ones and further copies) don't make it stale.
    """
    s = store.snapshot
    aside = s["skipped"] + s["duplicates"] if s else 0
    if s and not s["unreadable"] and sums(files.select("rel_path", "file_hash"), s["parts"]) == s["sums"]:
        return {"unchanged": s["episodes"], "new": aside, "edited": 0, "vanished": 0, "source": s["episodes"] + aside, "indexed": s["episodes"], "excluded": aside, "matches": True, "freshness": "current"}
    found = projection.sync_report(files, store.stored_hashes()).first().asDict()
    current = s is not None and not s["unreadable"] and not found["edited"] and not found["vanished"] and found["new"] == aside
    seen = {"source": found["unchanged"] + found["new"] + found["edited"], "indexed": found["unchanged"] + found["edited"] + found["vanished"], "excluded": aside}
    return found | seen | {"matches": current, "freshness": "current" if current else "stale"}
