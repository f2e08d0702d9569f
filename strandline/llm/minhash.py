"""Near-duplicates by SuperMinHash: signatures, bands, verification on full sets, union-find.

A text's set are its distinct four-word shingles. SuperMinHash gives every element a random permutation
of the signature's slots and one uniform number for each rank: slot k holds the least rank plus number
with which any element reaches k. Ranks are dealt in layers, and a set is done as soon as all its slots
are filled, since later layers can only give larger values; sets of many elements need one layer.

Equal sets are one node. Nodes that agree on the four slots of a band meet in a bucket. A bucket first
gives a spanning forest of its nodes by estimated similarity, whose edges are verified on full sets and
joined. Then only pairs of different components are left. Components with a pair in some bucket whose
estimate is above ``CUTOFF`` make a family, told by a spanning forest again, and in each family all pairs
of different components are held against each other on full sets. A pair of similarity 0.8 shares no band
with a probability of 5e-8, and is estimated below the cutoff with one of 1e-8. Large buckets and families
are dealt out in blocks, and what leaves a task grows with the nodes, never with their pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, slices, spread, table, texts, unused
from .simhash import Forest
from .simhash import components as by_joins

SEED, WORDS, PERCENT = 42, 4, 80
#: Slots of a signature and rows of a band.
SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
#: Pairs with a lower estimated similarity aren't verified.
CUTOFF = 0.6
#: A bucket of more nodes is dealt out in blocks of about so many (an exact step; nothing is left out).
GROUP_ROWS = 1024
#: A family of more elements is dealt out in blocks of about so many.
GROUP_ELEMENTS = 1 << 18
#: Elements whose permutations are held at once.
AT_ONCE = 1 << 17
#: Up to so many links (16 MB) are joined by one task; more of them by repeated joins.
ONE_TASK = 1 << 20
#: Partners of a node in a group that are read against its set together.
PARTNERS = 256


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; empty without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *(ends[:-WORDS]).tolist()]
    found = (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist()))
    return np.unique(np.fromiter(found, np.uint64, len(starts)))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash values, 16 bits of each: one row of ``SLOTS`` for each set (zeros for an empty one)."""
    out = np.zeros((len(sets), SLOTS), np.uint16)
    at, filled = 0, [i for i, s in enumerate(sets) if len(s)]
    while at < len(filled):
        some, size = [], 0
        while at < len(filled) and (not some or size + len(sets[filled[at]]) <= AT_ONCE):
            some.append(filled[at])
            size += len(sets[filled[at]])
            at += 1
        out[some] = _values([sets[i] for i in some])
    return out


def _values(sets: list[np.ndarray]) -> np.ndarray:
    values = np.full((len(sets), SLOTS), np.inf)
    flat, element = values.reshape(-1), np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    deal = None  # the permutations of the elements that are still of use, made after the first layer
    for rank in range(SLOTS):
        x = _mixed(element + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        pick = (rank + (((x & np.uint64(0xFFFFF)) * np.uint64(SLOTS - rank)) >> np.uint64(20))).astype(np.int64)
        if deal is None:
            slot = pick
        else:
            row = np.arange(len(element))
            slot = deal[row, pick].astype(np.int64)
            deal[row, pick] = deal[:, rank]
        np.minimum.at(flat, of * SLOTS + slot, rank + (x >> np.uint64(20)) * 2.0**-44)
        open_ = np.isinf(values).any(axis=1)
        if not open_.any():
            break
        keep = open_[of]
        if deal is None:
            first = pick[keep]
            deal = np.tile(np.arange(SLOTS, dtype=np.uint8), (len(first), 1))
            deal[np.arange(len(first)), first] = 0
            element, of = element[keep], of[keep]
        elif not keep.all():
            element, of, deal = element[keep], of[keep], deal[keep]
    return (_mixed(values.view(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _packed(cells: list[bytes]) -> pa.Array:
    return pa.array(cells, pa.binary())


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, r1, r2, n, d1, d2, sig) of (doc_id, r1, r2, text): size, 128-bit digest and signature of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            sets = [shingles(t) for t in texts(batch)]
            sig = signatures(sets)
            # Sums of two hashes of each element, as sets have no order.
            digest = np.array([(s.sum(), _mixed(s + np.uint64(1)).sum()) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            made = [pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), _packed([r.tobytes() for r in sig])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["doc_id", "r1", "r2", "n", "d1", "d2", "sig"])

    return docs.select("doc_id", "r1", "r2", "text").mapInArrow(run, "doc_id long, r1 long, r2 long, n long, d1 long, d2 long, sig binary")


def _key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """128 bits of a row's id and text."""
    return [F.xxhash64(docs[id_col], docs[text_col]).alias("r1"), F.xxhash64(F.lit("row"), docs[id_col], docs[text_col]).alias("r2")]


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node) where at least two nodes meet."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * 2 * ROWS + 1, F.lit(2 * ROWS))))
    rows = nodes.filter("n > 0").select("node", F.explode(keys).alias("bucket"))
    often = rows.groupBy("bucket").count().filter("count > 1").select("bucket")
    return rows.join(often, "bucket", "left_semi")


def _alike(sig: np.ndarray, sizes: np.ndarray, i: int, among: np.ndarray) -> np.ndarray:
    """Estimated similarities of one row to others; zero where the sizes alone rule 0.8 out."""
    est = (sig[among] == sig[i]).mean(axis=1)
    small, large = np.minimum(sizes[among], sizes[i]), np.maximum(sizes[among], sizes[i])
    return np.where(100 * small >= PERCENT * large, est, 0.0)


def _forest(sig: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the rows by the largest estimates above the cutoff: (row that is in the tree, row that joins it)."""
    rest, out = np.arange(len(sig)), []
    best, via = np.zeros(len(sig)), np.zeros(len(sig), np.int64)
    while len(rest):
        k = int(np.argmax(best[rest]))
        i = int(rest[k])
        if best[i] >= CUTOFF:
            out.append((int(via[i]), i))
        rest = np.delete(rest, k)
        est = _alike(sig, sizes, i, rest)
        nearer = est > best[rest]
        best[rest[nearer]], via[rest[nearer]] = est[nearer], i
    return out


def _bridges(sig: np.ndarray, sizes: np.ndarray, comp: np.ndarray, block: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """Pairs of rows of the two blocks above the cutoff that span all components that such pairs connect."""
    names, at = np.unique(comp, return_inverse=True)
    forest, out = Forest(len(names)), []
    roots = np.arange(len(names))
    for i in np.flatnonzero(block == hi):
        others = np.flatnonzero(block == lo)
        if lo == hi:
            others = others[others > i]
        others = others[roots[at[others]] != roots[at[i]]]
        if not len(others):
            continue
        joined = False
        for j in others[_alike(sig, sizes, i, others) >= CUTOFF].tolist():
            if forest.join(int(at[i]), int(at[j])):
                out.append((int(i), j))
                joined = True
        if joined:
            roots = np.array([forest.root(k) for k in range(len(names))])
    return out


def _across(sets: list[np.ndarray], comp: np.ndarray, block: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """Linked pairs of rows of the two blocks that join all components that such pairs link."""
    size = np.array([len(s) for s in sets])
    element = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.append(0, np.cumsum(size))
    names, at = np.unique(comp, return_inverse=True)
    forest, out = Forest(len(names)), []
    others = np.flatnonzero(block == lo)
    flat = np.concatenate([element[start[j] : start[j + 1]] for j in others])
    first = np.append(0, np.cumsum(size[others])[:-1])
    mark = np.zeros(int(element.max()) + 1, np.int32)
    for i in np.flatnonzero(block == hi):
        own = element[start[i] : start[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat], first)
        mark[own] = 0
        near = (100 * both >= PERCENT * (size[i] + size[others] - both)) & (comp[others] != comp[i])
        out += [(int(i), int(j)) for j in others[near] if forest.join(int(at[i]), int(at[j]))]
    return out


def _in_groups(groups: DataFrame, key: str, cell: str, found, name: str = "node") -> DataFrame:
    """(a, b, part): the ``name`` of both rows of the pairs that ``found`` gives of each group.

    ``groups`` has a row (key, lo, hi, node, n, comp, block, cell) for each node; a group is one of a key's
    pairs of blocks. ``found`` gets arrays of n, comp, block and the cells, and lo and hi. Every ``PARTNERS``
    pairs of a first row in a group make a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            left, right, part = [], [], []
            for lo, hi, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                order = np.argsort(rows.values.field("node").to_numpy())
                node, n, comp, block = (rows.values.field(f).to_numpy()[order] for f in ("node", "n", "comp", "block"))
                cells, seen = rows.values.field(cell).to_pylist(), Counter()
                named = comp if name == "comp" else node
                for i, j in found(n, comp, block, [cells[k] for k in order], lo, hi):
                    left.append(named[i])
                    right.append(named[j])
                    part.append(seen[i] // PARTNERS)
                    seen[i] += 1
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64()), pa.array(part, pa.int32())], names=["a", "b", "part"])

    lists = groups.groupBy(key, "lo", "hi").agg(F.collect_list(F.struct("node", "n", "comp", "block", cell)).alias("rows")).filter(F.size("rows") > 1)
    return lists.select("lo", "hi", "rows").mapInArrow(run, "a long, b long, part int")


def _matrix(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.uint16).reshape(-1, SLOTS)


def _salted(rows: DataFrame, keys: DataFrame, key: str, salts: int) -> DataFrame:
    """``rows`` (key, node) with the columns of ``keys``, the rows of a large key over several tasks."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int"))
    return dealt.join(keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "salt"]).drop("salt")


def _first_pairs(buckets: DataFrame, nodes: DataFrame, group_rows: int, salts: int) -> DataFrame:
    """The forests of all buckets. The blocks of a large one have its first node in common, which links them."""
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("node").alias("head"))
    many = F.ceil(F.col("rows") / group_rows).cast("int")
    dealt = _salted(buckets, sizes.select("bucket", "head", many.alias("blocks")), "bucket", salts)
    own = F.when(F.col("node") == F.col("head"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")))
    placed = dealt.withColumn("block", F.explode(own)).select("bucket", "node", "block", F.col("block").alias("lo"), F.col("block").alias("hi"))
    rows = placed.join(nodes.select("node", "n", "sig", F.col("node").alias("comp")), "node")
    return _in_groups(rows, "bucket", "sig", lambda n, comp, block, cells, lo, hi: _forest(_matrix(cells), n)).distinct()


def _in_blocks(rows: DataFrame, key: str, size, most: int, salts: int) -> DataFrame:
    """Rows (key, node, comp) of keys with several components, once for each pair (lo, hi) of blocks that they are in.

    Blocks of a key's largest component don't meet one another, so what is dealt grows with the nodes
    outside of it. A block has about ``most`` of ``size``.
    """
    each = rows.groupBy(key, "comp").agg(F.sum(size).alias("size"))
    sizes = each.groupBy(key).agg(F.max(F.struct("size", "comp")).alias("most"), F.sum("size").alias("size"), F.count("*").alias("comps")).filter("comps > 1")
    small, main = F.col("size") <= most, F.col("most.size")
    keys = sizes.select(
        key,
        F.when(small, F.lit(None)).otherwise(F.col("most.comp")).alias("giant"),
        F.when(small, 0).otherwise(F.ceil(main / most)).cast("int").alias("first"),
        F.when(small, 1).otherwise(F.ceil((F.col("size") - main) / most)).cast("int").alias("second"),
    )
    dealt = _salted(rows, keys, key, salts)
    in_giant = F.coalesce(F.col("comp") == F.col("giant"), F.lit(False))
    at = F.xxhash64("node", F.lit("block"))
    block = F.when(in_giant, F.pmod(at, F.greatest("first", F.lit(1)))).otherwise(F.col("first") + F.pmod(at, F.col("second"))).cast("int")
    meets = F.sequence(F.when(in_giant, F.col("first")).otherwise(F.lit(0)), F.col("first") + F.col("second") - 1)
    placed = dealt.withColumn("block", block).withColumn("with", F.explode(meets))
    return placed.select(key, "node", "comp", "block", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))


def _families(buckets: DataFrame, nodes: DataFrame, comps: DataFrame, group_rows: int, salts: int) -> DataFrame | None:
    """(node, comp, family) of all nodes whose component meets another one above the cutoff in some bucket; None if none does."""
    named = buckets.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = _in_blocks(named, "bucket", F.lit(1), group_rows, salts).join(nodes.select("node", "n", "sig"), "node")
    met = _in_groups(rows, "bucket", "sig", lambda n, comp, block, cells, lo, hi: _bridges(_matrix(cells), n, comp, block, lo, hi), "comp")
    met = checkpointed(met.drop("part"))
    if met.isEmpty():
        return None
    family = components(met).select(F.col("id").alias("comp"), F.col("component").alias("family"))
    # A component has the name of its first node; one that has no link is that node alone.
    alone = family.select(F.col("comp").alias("node"), "comp", "family")
    return checkpointed(comps.join(family, "comp").select("node", "comp", "family").unionByName(alone).distinct())


def _sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, set): the full sets of ``wanted`` (node, r1, r2), made anew of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed([shingles(t).tobytes() for t in texts(batch)])], names=["node", "set"])

    return checkpointed(docs.join(wanted, ["r1", "r2"]).select("node", "text").mapInArrow(run, "node long, set binary").dropDuplicates(["node"]))


def _verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The (a, b) among ``pairs`` (a, b, part) whose sets in ``full`` are similar enough.

    The first set is read once for each part of its partners, and these are held against it one by one.
    """
    hub = pairs.withColumnsRenamed({"a": "hub", "b": "node"})
    heads = hub.select("hub", "part").distinct().join(full.withColumnRenamed("node", "hub"), "hub").select("hub", "part", F.lit(None).cast("long").alias("node"), "set")
    rows = heads.unionByName(hub.join(full, "node").select("hub", "part", "node", "set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in slices(batches, 8 << 20):
            left, right = [], []
            for hub_, node, cell in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                these = np.frombuffer(cell.as_buffer(), np.uint64)
                if node is None:
                    own = these
                    continue
                at = np.searchsorted(own, these)
                both = int((own[np.minimum(at, len(own) - 1)] == these).sum())
                if 100 * both >= PERCENT * (len(own) + len(these) - both):
                    left.append(hub_)
                    right.append(node)
            own = own.copy()  # lets go of the batch that it came in
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    # A hub's own set comes first, as null sorts before any node.
    dealt = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "node")
    return dealt.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most: int = ONE_TASK) -> DataFrame:
    """(id, component): the smallest id reachable over (a, b), for every id that has a link.

    Links that are written already are counted first: up to ``most`` of them are joined by union-find in one task, which spares
    rounds of joins over few rows, and more of them by these rounds. Both give the same rows.
    """
    if edges.count() > most:
        return by_joins(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *(np.column_stack([c.to_numpy() for c in b.columns]) for b in batches)])
        ids, at = np.unique(pairs, return_inverse=True)
        forest = Forest(len(ids))
        for i, j in at.reshape(-1, 2).tolist():
            forest.join(i, j)
        roots = ids[[forest.root(i) for i in range(len(ids))]] if len(ids) else ids
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], names=["id", "component"])

    return checkpointed(edges.select("a", "b").coalesce(1).mapInArrow(run, "id long, component long"))


def linked(nodes: DataFrame, docs: DataFrame, group_rows: int = GROUP_ROWS, salts: int = 16, group_elements: int = GROUP_ELEMENTS) -> DataFrame:
    """(id, component) of the nodes that any link has."""
    buckets = checkpointed(_buckets(nodes))
    tried = checkpointed(_first_pairs(buckets, nodes, group_rows, salts))
    ends = tried.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    full = _sets(nodes.join(ends, "node", "left_semi").select("node", "r1", "r2"), docs)
    links = checkpointed(_verified(tried, full))
    comps = components(links)
    families = _families(buckets, nodes, comps.select(F.col("id").alias("node"), F.col("component").alias("comp")), group_rows, salts)
    if families is None:
        return comps
    # Nearly all of them have been in a pair already.
    more = checkpointed(families.select("node").join(full.select("node"), "node", "left_anti"))
    if not more.isEmpty():
        full = full.unionByName(_sets(nodes.join(more, "node").select("node", "r1", "r2"), docs))
    rows = _in_blocks(families.join(nodes.select("node", "n"), "node"), "family", F.col("n"), group_elements, salts)
    rows = rows.join(full.withColumn("n", F.octet_length("set") / 8), "node")
    arrays = lambda cells: [np.frombuffer(c, np.uint64) for c in cells]
    found = _in_groups(rows, "family", "set", lambda n, comp, block, cells, lo, hi: _across(arrays(cells), comp, block, lo, hi))
    return components(checkpointed(links.unionByName(found.drop("part"))))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS, salts: int = 16, group_elements: int = GROUP_ELEMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two texts are linked where 100 times the common shingles are at least 80 times all of both. Texts
    with equal sets are one node, so copies cost nothing beyond their own row. A null text, or one
    without words, has an empty set and is linked with nothing, copies of it neither. Repeated rows give
    repeated rows; rows that share an id but not a set are told apart, and all that have the component's
    smallest id are ``kept``. A row without an id takes its component's; where none has any, component_id
    is null and the row is kept. An empty table gives an empty result. Ids are whole numbers; columns
    other than the two named aren't looked at.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    docs = docs.select("*", *_key(docs, "doc_id", "text"))
    made = checkpointed(prints(docs))
    same = made.filter("n > 0").groupBy("n", "d1", "d2")
    nodes = same.agg(F.min("doc_id").alias("id"), F.count("*").alias("rows"), F.min(F.struct("r1", "r2")).alias("r"), F.first("sig").alias("sig"))
    nodes = checkpointed(nodes.select(F.monotonically_increasing_id().alias("node"), "n", "d1", "d2", "id", "rows", "r.r1", "r.r2", "sig"))
    comps = linked(nodes, docs, group_rows, salts, group_elements)
    named = nodes.join(comps.withColumnRenamed("id", "node"), "node", "left").withColumn("c", F.coalesce("component", "node"))
    company = named.filter(F.col("component").isNotNull() | (F.col("rows") > 1)).select("n", "d1", "d2", "c", "id")
    least = company.groupBy("c").agg(F.min("id").alias("component_id"))
    clusters = company.join(least, "c").select("n", "d1", "d2", "component_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = made.select("doc_id", "n", "d1", "d2", F.pmod(F.xxhash64("r1"), F.lit(salts)).cast("int").alias("salt"))
    found = rows.join(clusters, ["n", "d1", "d2", "salt"], "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``near_duplicates`` doesn't keep; rows without an id stay."""
    gone = near_duplicates(docs, id_col, text_col).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    mark = unused("_id", docs.columns)
    return docs.withColumn(mark, docs[id_col].cast("long")).join(gone.withColumnRenamed("doc_id", mark), mark, "left_anti").drop(mark)


def op11_minhash(spark, sf_dir):
    """Shingles and component of every document."""
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words
), elements AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common
  FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared WHERE 100 * common >= 80 * (nx + ny - common)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), least AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON x = doc_id
"""
