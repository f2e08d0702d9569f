"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on seeds: equal runs of as many tokens as the shortest tile
has, so every tile holds one. Pairs that the seeds show to be covered too little, whatever the tiles,
are left out. For every other pair, the longest common runs that don't overlap earlier ones are marked
again and again, found by running Karp-Rabin hashes, and the share of the item's tokens that is covered
decides. Passages whose parts stand in another order are covered as well. Items of at most ``WHOLE``
tokens must occur whole, as parts of them are common phrases.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, slices, spread, table, texts

MIN_TILE, COVERAGE = 3, 0.8
#: Items of at most this many tokens must occur whole.
WHOLE = 5
#: Above this size of the benchmark's texts, seeds meet in a shuffle instead of in every worker.
WORKER_BYTES = 4 << 20
#: Tasks over which the documents that hold one seed are dealt.
SALTS = 16

WORD = re.compile(r"\w+")
BASE, PRIME = 1_000_003, (1 << 61) - 1
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def _windows(codes: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of each run of ``s`` unmarked tokens; the hash rolls from one to the next."""
    drop, h, n = pow(BASE, s - 1, PRIME), 0, 0
    for i, c in enumerate(codes):
        if not free[i]:
            h = n = 0
            continue
        if n == s:
            h = (h - codes[i - s] * drop) % PRIME
        else:
            n += 1
        h = (h * BASE + c) % PRIME
        if n == s:
            yield i - s + 1, h


def tile(item: list[str], doc: list[str], least: int = MIN_TILE) -> int:
    """Tokens of ``item`` that greedy tiles of at least ``least`` tokens cover in ``doc``.

    Each round finds the common runs of at least s unmarked tokens; where one is longer than twice s, the
    round starts again with its length. The longest is marked, ties in order of their place in the item
    and then in the document; of a run that marked tokens cut, the parts that are left stay in the race.
    Then s goes down. So the longest common run of unmarked tokens is marked at every step.
    """
    code = {w: i + 1 for i, w in enumerate(dict.fromkeys(item))}
    a, b = [code[w] for w in item], [code.get(w, 0) for w in doc]
    free_a, free_b = [True] * len(a), [c > 0 for c in b]
    s, covered = max(least, min(20, len(a))), 0
    while s >= least > 0:
        at = defaultdict(list)
        for j, h in _windows(b, free_b, s):
            at[h].append(j)
        found: list[tuple[int, int, int]] = []
        longest = 0
        for i, h in _windows(a, free_a, s):
            for j in at.get(h, ()):
                if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                    continue  # the run began before
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k >= s:
                    longest = max(longest, k)
                    found.append((-k, i, j))
            if longest > 2 * s:
                break
        if longest > 2 * s:
            s = longest
            continue
        heapify(found)
        while found:
            k, i, j = heappop(found)
            open_ = [free_a[i + t] and free_b[j + t] for t in range(-k)]
            if all(open_):
                free_a[i : i - k] = free_b[j : j - k] = [False] * -k
                covered -= k
                continue
            begin = 0
            for t, free in enumerate([*open_, False]):
                if not free:
                    if t - begin >= s:
                        heappush(found, (begin - t, i + begin, j + begin))
                    begin = t + 1
        s = s // 2 if s > 2 * least else least if s > least else 0
    return covered


def shortest(n: int, least: int = MIN_TILE) -> int:
    """Tokens of the shortest tile that counts for an item of ``n`` tokens."""
    return n if n <= WHOLE else min(n, least)


def _run_keys(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit key of each run of ``k`` codes."""
    keys = np.zeros(max(len(codes) - k + 1, 0), np.uint64)
    for j in range(k):
        keys = keys * MULTIPLIER + codes[j : j + len(keys)]
    return keys


class Benchmark:
    """Distinct items by place, and the runs of tokens by which documents find them."""

    def __init__(self, rows: list[tuple[int, str]], least: int = MIN_TILE):
        self.ids, self.items = [], []
        for i, t in dict.fromkeys(rows):
            if w := tokens(t):
                self.ids.append(i)
                self.items.append(w)
        self.codes: dict[str, int] = {}
        self.sizes = np.array([len(w) for w in self.items], np.int64)
        self.item_of = np.repeat(np.arange(len(self.items)), self.sizes)
        flat = np.fromiter((self.codes.setdefault(w, len(self.codes) + 1) for item in self.items for w in item), np.uint64, len(self.item_of))
        #: By length: the keys of runs in order, and where in the items' tokens each begins.
        self.runs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lengths = np.array([shortest(n, least) for n in self.sizes.tolist()], np.int64)
        for k in np.unique(lengths).tolist():
            keys = _run_keys(flat, k)
            within = (lengths[self.item_of[: len(keys)]] == k) & (self.item_of[: len(keys)] == self.item_of[k - 1 :])
            at = np.flatnonzero(within)
            order = np.argsort(keys[at], kind="stable")
            self.runs[k] = keys[at][order], at[order]

    def near(self, doc: list[str], threshold: float = COVERAGE) -> list[int]:
        """Items of which runs that the document has, too, cover the share ``threshold``.

        A run has as many tokens as the shortest tile that counts for the item. Tiles lie within
        these runs, so no item is left out that tiles could cover.
        """
        codes = np.fromiter((self.codes.get(w, 0) for w in doc), np.uint64, len(doc))
        covered = []
        for k, (keys, at) in self.runs.items():
            asked = _run_keys(codes, k)
            known = np.ones(len(asked), bool)
            for j in range(k):
                known &= codes[j : j + len(asked)] > 0
            asked = np.unique(asked[known])
            first = np.searchsorted(keys, asked)
            n = np.searchsorted(keys, asked, side="right") - first
            hits = at[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
            covered.append((hits[:, None] + np.arange(k)).ravel())
        if not covered:
            return []
        places, n = np.unique(self.item_of[np.unique(np.concatenate(covered))], return_counts=True)
        return places[n / self.sizes[places] >= threshold].tolist()


def coverage(item: list[str], doc: list[str], least: int = MIN_TILE) -> float:
    return tile(item, doc, shortest(len(item), least)) / len(item) if item else 0.0


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, least: int = MIN_TILE, worker_bytes: int = WORKER_BYTES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item; whether one does depends on its text alone."""
    bench = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > worker_bytes:
        # 128 bits of the text, so that no clean one goes with a text that it isn't.
        key = F.concat_ws(" ", F.xxhash64(docs[text_col]).cast("string"), F.xxhash64(F.lit("text"), docs[text_col]).cast("string"))
        keyed = docs.select(key.alias("k"), docs[text_col].alias("text"))
        bad = contaminated(keyed, bench, threshold, least, worker_bytes, "k").select("doc_id").distinct()
        return docs.join(bad, key == bad["doc_id"], "left_anti")
    rows = [(r[0], r[1]) for r in bench.collect()]

    @F.arrow_udf("boolean")
    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Benchmark(rows, least)
        holds = lambda doc: any(coverage(known.items[i], doc, least) >= threshold for i in known.near(doc, threshold))
        for batch in batches:
            yield pa.array((not holds(tokens(t.as_py())) for t in batch), pa.bool_())

    return docs.filter(good(docs[text_col]))


def _pairs(rows: list[tuple[int, str]], least: int, threshold: float, id_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(rows, least)
        for batch in slices(batches, 8 << 20):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch)):
                doc = tokens(text)
                for i in bench.near(doc, threshold):
                    share = coverage(bench.items[i], doc, least)
                    if share >= threshold:
                        out.append((doc_id, bench.ids[i], len(bench.items[i]), share))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], t) for k, t in enumerate((id_kind, pa.int64(), pa.int64(), pa.float64()))],
                names=["doc_id", "item_id", "n_tokens", "coverage"],
            )

    return run


def _seeds(df: DataFrame, lengths: list[int]) -> DataFrame:
    """(key, h): the distinct runs of ``lengths`` tokens of texts (key, text)."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            keys, found = [], []
            for key, text in zip(batch.column(0).to_pylist(), texts(batch)):
                w = tokens(text)
                runs = {" ".join(w[j : j + k]) for k in lengths for j in range(len(w) - k + 1)}
                keys += [key] * len(runs)
                found += map(xxh64_intdigest, runs)
            h = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), h], names=["key", "h"])

    return df.mapInArrow(run, "key long, h long")


def _item_seeds(items: DataFrame, least: int) -> DataFrame:
    """(b, n, k, place, h): the seeds of items (b, text) of n tokens, k tokens each, by place."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            rows = []
            for b, text in zip(batch.column(0).to_pylist(), texts(batch)):
                w = tokens(text)
                k = shortest(len(w), least)
                rows += [(b, len(w), k, j, xxh64_intdigest(" ".join(w[j : j + k]))) for j in range(len(w) - k + 1) if k]
            kinds = (np.int64, np.int32, np.int32, np.int32, np.uint64)
            made = [np.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64) if m.dtype == np.uint64 else m) for m in made], names=["b", "n", "k", "place", "h"])

    return items.mapInArrow(run, "b long, n int, k int, place int, h long")


def _asked(seeds: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """Distinct (b, h): seeds of each item of which any document that reaches ``threshold`` has one.

    A token that tiles cover lies in one of its seeds that the document has, too. A document without any
    seed of some tokens covers none of these, and if they are more than it may leave out, it can't reach
    the threshold. So the tokens with the rarest seeds are taken, as many as that, with all their seeds.
    ``held`` says how many documents have a seed (h, documents).
    """
    rows = seeds.join(held, "h", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
    tokens_ = rows.select("b", "n", "documents", F.explode(F.sequence(F.col("place"), F.col("place") + F.col("k") - 1)).alias("token"))
    cost = tokens_.groupBy("b", "n", "token").agg(F.max("documents").alias("cost"))
    spare = F.col("n") - F.ceil(F.col("n") * threshold - 1e-6)
    rarest = cost.withColumn("at", F.row_number().over(Window.partitionBy("b").orderBy("cost", "token"))).filter(F.col("at") <= spare + 1)
    within = F.explode(F.sequence(F.col("place"), F.col("place") + F.col("k") - 1))
    return seeds.select("b", "h", within.alias("token")).join(rarest.select("b", "token"), ["b", "token"], "left_semi").select("b", "h").distinct()


def _candidates(keyed: DataFrame, items: DataFrame, threshold: float, least: int) -> DataFrame:
    """(k, b): texts (k, text) and items (b, text) that share a seed without which the threshold is out of reach."""
    seeds = checkpointed(_item_seeds(items.select("b", "text"), least))
    lengths = sorted(r["k"] for r in seeds.select("k").distinct().collect())  # ``WHOLE`` and one at most
    found = _seeds(keyed.select(F.col("k").alias("key"), "text"), lengths or [least])
    # Only seeds that the benchmark has are of use; what is left of the documents is written once.
    found = checkpointed(found.join(seeds.select("h").distinct(), "h", "left_semi").distinct())
    asked = _asked(seeds, found.groupBy("h").agg(F.count("*").alias("documents")), threshold)
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    copies = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return found.withColumn("salt", salt).join(copies, ["h", "salt"]).select(F.col("key").alias("k"), "b").distinct()


def _reaches(item: list[str], doc: list[str], threshold: float, least: int) -> bool:
    """Whether seeds that the document has, too, cover enough of the item."""
    k = shortest(len(item), least)
    runs = {tuple(doc[j : j + k]) for j in range(len(doc) - k + 1)}
    covered = {t for j in range(len(item) - k + 1) if tuple(item[j : j + k]) in runs for t in range(j, j + k)}
    return len(covered) >= threshold * len(item) > 0


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = COVERAGE,
    least: int = MIN_TILE,
    worker_bytes: int = WORKER_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_tokens, coverage) of pairs whose coverage reaches ``threshold``.

    Every document meets every item of which it has one of the rarest seeds, as many of them as a document
    that reaches the threshold can't do without; there is no cap. Items of at most
    ``WHOLE`` tokens must occur whole. Items without a token, null texts and empty tables give no rows;
    repeated documents give repeated rows. A benchmark of at most ``worker_bytes`` of text goes to
    every worker; a larger one is joined on hashed seeds and each pair's texts are brought together. Both
    ways cut the same tokens and give the same rows; equal benchmark rows count once, and items that share
    an id are items of their own. Item ids are whole numbers.
    """
    bench = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    if size <= worker_bytes:
        rows = [(r[0], r[1]) for r in bench.collect()]
        id_kind = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
        return slim.mapInArrow(_pairs(rows, least, threshold, id_kind), f"doc_id {id_type}, item_id long, n_tokens long, coverage double")
    # Documents that share a text share its work: pairs are formed between texts.
    keyed = slim.withColumn("k", F.xxhash64("text"))
    bench = bench.distinct().withColumn("b", F.xxhash64("item_id", "text"))
    shared = checkpointed(_candidates(keyed, bench, threshold, least))
    texts_of = keyed.select("k", "text", "doc_id").join(shared, "k").join(bench.withColumnRenamed("text", "item"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            both = [(tokens(i), tokens(d)) for i, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            share = [coverage(i, d, least) if _reaches(i, d, threshold, least) else 0.0 for i, d in both]
            n = pa.array([len(i) for i, _ in both], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(share, pa.float64())], names=["doc_id", "item_id", "n_tokens", "coverage"])

    return (
        texts_of.select("doc_id", "item_id", "item", "text")
        .mapInArrow(run, f"doc_id {id_type}, item_id long, n_tokens long, coverage double")
        .filter(F.col("coverage") >= threshold)
    )


def op10_decontaminate(spark, sf_dir):
    """Documents that contain a benchmark item: doc_id, item_id, n_tokens, coverage."""
    return contaminated(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
