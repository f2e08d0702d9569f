"""Near-duplicates by SimHash, with pivot distance tables.

Every text gets a 64-bit fingerprint of its three-word shingles. Distinct fingerprints that agree on two
of five bit fields meet in a group (of fingerprints that differ in at most three bits, at least two
fields are equal, so none is missed). Inside a group, the Hamming distances of each fingerprint to many
reference fingerprints are computed once; a pair whose distances to any reference differ by more than
the limit is discarded, as the triangle inequality allows, and the others are verified. Components of
the links come from repeated joins, with a checkpoint after each.

Bit fields come before pivots because distances to references can't deal pairs out: two unrelated
fingerprints pass one reference with a probability of 0.46, and a window of distances that misses no
pair has to be read with its neighbours, so each further reference as a key makes more rows than it
separates. All references together leave about one unrelated pair in 10^8, which is what they are used for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices, spread, table, texts, unused

SEED, WORDS, LIMIT, PIVOTS = 42, 3, 3, 24
#: First bit and width of the five fields.
FIELDS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: A group of more fingerprints is dealt out anew by further bits (an exact step; nothing is left out).
GROUP_ROWS = 4096


def fingerprint(text: str | None) -> int:
    """The SimHash of a text; zero if it has no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= WORDS:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *(ends[: -WORDS]).tolist()]
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist())]
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * bits > len(hashes))
    return int(sum(1 << int(i) for i in set_bits))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp, and the long columns ``keep``): one row per row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], names=["doc_id", "fp", *keep])

    slim = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), *keep)
    return slim.mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} long" for c in keep)]))


def _pivots() -> np.ndarray:
    """Reference fingerprints: zero, fields of ones, and words from a fixed generator."""
    rng = np.random.default_rng(SEED)
    plain = [0, *(((1 << w) - 1) << a for a, w in FIELDS)]
    return np.array([*plain, *rng.integers(0, 1 << 64, PIVOTS - len(plain), dtype=np.uint64).tolist()], np.uint64)


def links(fps: np.ndarray, pivots: np.ndarray, limit: int = LIMIT, block: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j in the order of the first distance) of fingerprints within ``limit`` bits.

    The rows are ordered by their distance to the first pivot, so that a block meets only those whose
    distance is at most ``limit`` larger; the other distances discard pairs before the last check.
    """
    distance = np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)
    order = np.argsort(distance[:, 0], kind="stable")
    distance, first = distance[order], distance[order, 0]
    for a in range(0, len(fps), block):
        b = min(a + block, len(fps))
        for c in range(a, int(np.searchsorted(first, first[b - 1] + limit, "right")), block):
            d = min(c + block, len(fps))
            near = np.ones((b - a, d - c), bool)
            for p in range(distance.shape[1]):
                near &= np.abs(distance[a:b, None, p] - distance[None, c:d, p]) <= limit
                if p % 6 == 5 and near.sum() * 8 < near.size:
                    break
            i, j = np.nonzero(near)
            i, j = i + a, j + c
            keep = i < j
            i, j = i[keep], j[keep]
            rest = (np.abs(distance[i] - distance[j]) <= limit).all(axis=1)
            i, j = order[i[rest]], order[j[rest]]
            true = np.bitwise_count(fps[i] ^ fps[j]) <= limit
            yield i[true], j[true]


class Forest:
    """Union by smallest index."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _masks() -> list[int]:
    """Bits that two of the five fields fix."""
    bits = [((1 << w) - 1) << a for a, w in FIELDS]
    return [x | y for x, y in combinations(bits, 2)]


def _quarters(mask: int) -> list[int]:
    """``mask`` with each of four parts of the bits that it leaves open: one part is equal in any pair of three differences."""
    rest = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(rest) * k // 4 for k in range(5)]
    return [mask | sum(1 << i for i in rest[a:b]) for a, b in zip(cuts, cuts[1:])]


def _in_groups(dealt: DataFrame, limit: int) -> DataFrame:
    """(a, b): a spanning forest of the links in each group of (mask, value, fp), by pivots."""
    # Many groups have one row; they are dropped before any leaves the JVM.
    grouped = dealt.groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    pivots = _pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16 << 20):
            left, right = [], []
            for fps in batch.column(0):
                fps = fps.values.to_numpy().view(np.uint64)
                forest = Forest(len(fps))
                for i, j in links(fps, pivots, limit):
                    for x, y in zip(i.tolist(), j.tolist()):
                        if forest.join(x, y):
                            left.append(fps[x])
                            right.append(fps[y])
            both = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (left, right)]
            yield pa.RecordBatch.from_arrays(both, names=["a", "b"])

    return grouped.select("fps").mapInArrow(run, "a long, b long")


def _linked(nodes: DataFrame, limit: int = LIMIT, group_rows: int = GROUP_ROWS, salts: int = 16) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that join all that are within ``limit`` bits, at most three.

    Each group gives a spanning forest of its links, not all of them. A group of over ``group_rows``
    rows is dealt out again by one of four parts of the bits that its fields leave open, and what is
    still too large again, so no task gathers more (nor more than 8, if that is larger); every pair still
    meets, as three differences leave one of four parts alone.
    """
    if limit > LIMIT:
        raise ValueError(f"the fields find pairs of up to {LIMIT} differences")
    masks = _masks()
    rows, found = nodes.select("fp"), []
    key = lambda m: F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
    dealt = rows.select("fp", F.explode(F.array(*map(key, masks))).alias("key")).select("fp", "key.*")
    while True:
        large = checkpointed(dealt.groupBy("mask", "value").count().filter((F.col("count") > group_rows) & (F.bit_count("mask") <= 60)).select("mask", "value"))
        listed = sorted(r["mask"] for r in large.select("mask").distinct().collect())  # ten at first, four times as many by level
        if not listed:
            found.append(_in_groups(dealt, limit))
            break
        # Rows of a large group are many: they meet its key in several tasks.
        salted = dealt.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int"))
        keys = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on = ["mask", "value", "salt"]
        found.append(_in_groups(salted.join(keys, on, "left_anti"), limit))
        finer = dealt.sparkSession.createDataFrame([(m, [_signed(q) for q in _quarters(m % (1 << 64))]) for m in listed], "mask long, finer array<long>")
        again = salted.join(keys, on, "left_semi").join(F.broadcast(finer), "mask").select("fp", F.explode("finer").alias("mask"))
        dealt = checkpointed(again.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).distinct())
    return reduce(DataFrame.unionByName, found).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over (a, b), for every id that has a link.

    Every node points at the smallest neighbour; alternately, larger neighbours are handed to it and
    then smaller ones, until nothing changes. Each round is written to the shared folder.
    """
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    after = None
    for _ in range(rounds):
        # Large star: each node's larger neighbours go to the smallest of its neighbours and itself.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("low"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.distinct()
        # Small star: each node and its smaller neighbours go to the smallest of these.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter(F.col("b") > F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        new = checkpointed(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        before, after, edges = after, new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first(), new
        if before == after:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _clusters(prints: DataFrame, limit: int, group_rows: int) -> DataFrame:
    """(fp, c, component_id) of fingerprints that have company: c names the component, component_id is its smallest id."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    linked = components(_linked(nodes, limit, group_rows))
    named = nodes.join(linked.withColumnRenamed("id", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    smallest = named.filter(F.col("component").isNotNull() | (F.col("n") > 1)).select("fp", "c", "id")
    return smallest.join(smallest.groupBy("c").agg(F.min("id").alias("component_id")), "c").select("fp", "c", "component_id")


def _spread(prints: DataFrame, clusters: DataFrame, salts: int) -> DataFrame:
    """``prints`` with the columns of ``clusters``; a hot fingerprint's rows are dealt over ``salts`` tasks."""
    salted = clusters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    return rows.join(salted, ["fp", "salt"], "left").drop("salt")


def near_duplicates(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", salts: int = 8, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Equal fingerprints are one node, so copies cost nothing beyond their own row. Null and empty texts
    have fingerprint zero and link with each other and with any text within ``limit`` bits of it.
    Repeated rows give repeated rows. A component made of null ids alone has a null component_id. An
    empty table gives an empty result. Ids are whole numbers.
    """
    # Ids and fingerprints are read three times below; texts only once.
    prints = checkpointed(fingerprints(docs, id_col, text_col))
    return _spread(prints, _clusters(prints, limit, group_rows), salts).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", salts: int = 8, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id; rows without an id stay as they are.

    Rows that share an id but not a component all stay. Of a component's rows that share the smallest
    id, the one with the smallest hash of its text stays, and of rows that share the text, too, the one
    with the smallest hash of all columns.
    """
    t = F.coalesce(docs[text_col], F.lit(""))
    named = docs.filter(docs[id_col].isNotNull())
    own = [F.xxhash64(docs[id_col], t), F.xxhash64(F.lit("row"), docs[id_col], t)]
    prints = docs.select(docs[id_col].cast("long").alias("doc_id"), t.alias("text"), *[h.alias(n) for h, n in zip(own, ("r1", "r2"))])
    prints = checkpointed(fingerprints(prints, keep=("r1", "r2")))
    grouped = _spread(prints, _clusters(prints, limit, group_rows).select("fp", "c"), salts).filter(F.col("doc_id").isNotNull())
    first = grouped.groupBy(F.coalesce("c", "fp").alias("c")).agg(F.min(F.struct("doc_id", "r1", "r2")).alias("first"))
    r1, r2 = unused("_r1", docs.columns), unused("_r2", docs.columns)
    stay = first.select(F.col("first.r1").alias(r1), F.col("first.r2").alias(r2))
    kept = named.withColumns(dict(zip((r1, r2), own))).join(stay, [r1, r2], "left_semi")
    plain = [c for c in docs.columns if not docs.schema[c].dataType.simpleString().startswith("map")]
    kept = kept.groupBy(r1, r2).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias(unused("_row", docs.columns)))
    return kept.select(f"{kept.columns[-1]}.*").unionByName(docs.filter(docs[id_col].isNull()))


def op9_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
