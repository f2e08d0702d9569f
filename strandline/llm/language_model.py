"""Scoring by an n-gram language model held as a weighted backoff automaton.

Counts come from all training documents. Documents are dealt into blocks by a hash; each block sends
its distinct n-grams, packed by hash bucket, with their training counts; buckets add up the counts of
equal n-grams over all blocks and answer each block in the order of its question. A block asks only the
buckets that hold n-grams of its own, so what is exchanged grows with the n-grams, never with blocks
times buckets. A block then has the counts of exactly the n-grams that its texts use, builds its part
of the automaton and reads its texts from left to right. No vocabulary or model is gathered in one
place, and no n-gram is left out.

The model: P(w) = (c(w) + 1) / (N + V + 1) and, for a history h of one more word,
P(w | h) = (c(h w) + m P(w | h')) / (c(h) + m), where h' is h without its first word. Histories seen in
training are states. A state has an arc for each word seen after it, to the longest history that then
holds, and a failure arc of weight m / (c(h) + m) to the state of h'. Weights are base-10 logarithms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, slices, spread, table, texts

#: Words per n-gram, the weight of shorter histories, and the bytes of text that a block should hold.
ORDER, WEIGHT, BLOCK_BYTES = 3, 20.0, 8 << 20
#: Tokens whose arcs are looked up at a time, and distinct words that a task holds while it counts.
TRAVERSED, KEPT = 100_000, 1_000_000
#: Bits of a hash by which n-grams are told apart.
KEY_BITS = 60
#: Hashes of what is no word: a text's begin and its end.
START, END = 1, 2
MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, in order."""
    h = (a * MIX + b) & np.uint64(0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _cut(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - KEY_BITS)


def _planes(values: np.ndarray) -> bytes:
    """Integers, compressed with one byte of all of them after the other, so that the zeros lie together."""
    return pa.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True) if len(values) else b""


def _values(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(raw, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(_values(raw, n), dtype=np.uint64)


class Block:
    """The tokens of some texts, as indices into the block's distinct n-grams of each length."""

    def __init__(self, texts: list[str], order: int = ORDER):
        from xxhash import xxh64_intdigest

        ids: dict[bytes, int] = {}
        listed, lengths = [], []
        for t in texts:
            words = t.encode().lower().split()
            listed.append(np.fromiter([ids.setdefault(w, len(ids)) for w in words], np.int32, len(words)))
            lengths.append(len(words) + 1)
        self.lengths = np.array(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        starts = self.ends - self.lengths
        end = len(ids)
        tokens = np.full(int(self.ends[-1]) if lengths else 0, end, np.int32)
        at = 0
        for part in listed:
            tokens[at : at + len(part)] = part
            at += len(part) + 1
        hashes = np.fromiter((xxh64_intdigest(w, 7) for w in ids), np.uint64, len(ids))
        #: hashes[n]: distinct n-grams of n + 1 words; grams[n]: of each token with the n words before it.
        self.hashes, self.grams = [np.append(hashes, np.uint64(END))], [tokens]
        self.histories: list[np.ndarray] = []
        # place: how many words of the same text stand before a token.
        place = np.arange(len(tokens)) - np.repeat(starts, self.lengths)
        for n in range(1, order):
            # The history of a token: the gram of n words that ends before it; at a text's begin it is padded.
            before = np.empty_like(tokens)
            before[1:] = self.grams[n - 1][:-1]
            padded = len(self.hashes[n - 1])
            if len(tokens):
                before[0] = padded
            before[place == 0] = padded
            wide = np.append(self.hashes[n - 1], np.uint64(START + 16 * n))
            pairs, inverse = np.unique(before.astype(np.int64) * (end + 1) + tokens, return_inverse=True)
            left, right = pairs // (end + 1), pairs % (end + 1)
            self.hashes.append(_mixed(wide[left], self.hashes[0][right]))
            self.grams.append(inverse.astype(np.int32))
            self.histories.append(before)

    def counts(self, used: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram stands in the texts that are marked."""
        chosen = np.repeat(used, self.lengths)
        return [np.bincount(g[chosen], minlength=len(h)) for g, h in zip(self.grams, self.hashes)]

    def keys(self, order: int = ORDER) -> np.ndarray:
        """The key of every n-gram, those of different lengths apart."""
        return np.concatenate([_cut(_mixed(h, np.full(len(h), n, np.uint64))) for n, h in enumerate(self.hashes)])


class Automaton:
    """The states, arcs and failure arcs that a block's texts use.

    State 0 is the empty history; the others are the histories that training saw, and the padding at a
    text's begin. State s stands for ``depth[s]`` words and fails to ``fail[s]`` at ``fail_weight[s]``.
    Arc a leads to state ``target[a]`` and weighs ``weight[a]``. ``arcs[n]`` gives the arc of each
    (n + 1)-gram, from the state of its first n words, or -1 if training lacks it.
    """

    def __init__(self, counts: list[np.ndarray], block: Block, total: int, distinct: int, documents: int, weight: float):
        order, self.block = len(counts), block
        #: By length: each history's state, with the padding last; one that training lacks has that of its next shorter one.
        states, size = [], 1
        fails, fail_weights, depth = [np.zeros(1, np.int32)], [np.zeros(1)], [b"\0"]
        self.arcs, targets, weights, at = [], [], [], 0
        below = (counts[0] + 1.0) / (total + distinct + 1.0)
        for n in range(order):
            inner = None
            if n:
                # Each n-gram without its first word, and without its last one.
                inner, first = np.zeros(len(counts[n]), np.int32), np.zeros(len(counts[n]), np.int32)
                inner[block.grams[n]] = block.grams[n - 1]
                first[block.grams[n]] = block.histories[n - 1]
                below = (counts[n] + weight * below[inner]) / (np.append(counts[n - 1], documents)[first] + weight)
                del first
            weights.append(np.log10(below))
            shorter = np.append(states[n - 1][inner], states[n - 1][-1]) if n else np.zeros(len(counts[0]) + 1, np.int32)
            if n < order - 1:
                history = np.append(counts[n], documents)
                seen = history > 0
                states.append(np.where(seen, size + np.cumsum(seen) - 1, shorter).astype(np.int32))
                fails.append(shorter[seen])
                fail_weights.append(np.log10(weight / (history[seen] + weight)))
                depth.append(bytes([n + 1]) * int(seen.sum()))
                size += int(seen.sum())
                targets.append(states[n][:-1])
            else:
                targets.append(shorter[:-1])
            numbers = np.arange(at, at + len(counts[n]), dtype=np.int32)
            self.arcs.append(np.where(counts[n] > 0, numbers, -1) if n else numbers)
            at += len(counts[n])
        self.start = int(states[-1][-1]) if states else 0
        self.depth, self.fail, self.fail_weight = b"".join(depth), np.concatenate(fails), np.concatenate(fail_weights)
        self.target, self.weight = np.concatenate(targets), np.concatenate(weights)

    def scores(self, tokens: int = TRAVERSED) -> np.ndarray:
        """The log10 probability of each text, read from left to right with the state carried on.

        From the state, the arc of the next word is taken where there is one; else failure arcs are
        followed, each adding its weight, until a state has one. The empty history has an arc for every
        word, unknown ones included. A block's n-grams are numbered, so the next word's arc from a state
        of n words is looked up by the (n + 1)-gram that ends there, for ``tokens`` tokens at a time.
        """
        block, ends, out = self.block, self.block.ends.tolist(), np.zeros(len(self.block.lengths))
        depth, (target, weight, fail, fail_weight) = self.depth, map(memoryview, (self.target, self.weight, self.fail, self.fail_weight))
        text, state, total = 0, self.start, 0.0
        for begin in range(0, len(block.grams[0]), tokens):
            here = [a[g[begin : begin + tokens]].tolist() for a, g in zip(self.arcs, block.grams)]
            for i in range(len(here[0])):
                arc = here[depth[state]][i]
                while arc < 0:
                    total += fail_weight[state]
                    state = fail[state]
                    arc = here[depth[state]][i]
                total += weight[arc]
                state = target[arc]
                if begin + i + 1 == ends[text]:
                    out[text] = total
                    text, state, total = text + 1, self.start, 0.0
        return out


def _buckets(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets (ranges of keys) that hold any of some ascending keys, and where each begins."""
    held, begins = np.unique((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(n) >> np.uint64(32), return_index=True)
    return held.astype(np.int32), np.append(begins, len(keys))


def training_totals(slim: DataFrame, n_buckets: int) -> tuple[int, int, int]:
    """Tokens, distinct tokens and documents of (text, train): words are told apart by their keys."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            keys = np.sort(_cut(np.array([END, *(xxh64_intdigest(w, 7) for w in seen)], np.uint64)))
            held, cuts = _buckets(keys, n_buckets)
            first = np.arange(len(held)) == 0
            parts = [pa.array(held), pa.array([_packed(keys[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array(np.diff(cuts)), pa.array(first * n), pa.array(first * documents)]
            return pa.RecordBatch.from_arrays(parts, names=["bucket", "words", "n_words", "tokens", "documents"])

        seen, n, documents = set(), 0, 0
        for batch in slices(batches):
            for text in texts(batch):
                words = text.encode().lower().split()
                n, documents = n + len(words) + 1, documents + 1
                seen.update(words)
            if len(seen) > KEPT:
                yield rows()
                seen, n, documents = set(), 0, 0
        if documents:
            yield rows()

    def count(group: pa.Table) -> pa.Table:
        words = [_unpacked(w, n) for w, n in zip(group.column("words").to_pylist(), group.column("n_words").to_pylist())]
        return pa.table({"tokens": [pc.sum(group.column("tokens")).as_py()], "words": [len(np.unique(np.concatenate(words)))], "documents": [pc.sum(group.column("documents")).as_py()]})

    each = slim.filter("train").select("text").mapInArrow(run, "bucket int, words binary, n_words long, tokens long, documents long")
    each = each.groupBy("bucket").applyInArrow(count, "tokens long, words long, documents long")
    return tuple(each.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in each.columns]).first())


def _in_blocks(dealt: DataFrame, kind: str) -> DataFrame:
    """Rows (doc_id, text, train, block) packed by task and block, texts compressed, for the way to their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            blocks = batch.column(3).to_numpy()
            order = np.argsort(blocks, kind="stable")
            batch = batch.take(pa.array(order))
            cuts = np.append(np.unique(blocks[order], return_index=True)[1], len(blocks)).astype(np.int32)
            raw = [t.encode() for t in texts(batch)]
            lists = [pa.ListArray.from_arrays(pa.array(cuts), c) for c in (batch.column(0), batch.column(2), pa.array([len(r) for r in raw], pa.int32()))]
            packed = [pa.compress(b"".join(raw[a:b]), "zstd", asbytes=True) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(3).take(pa.array(cuts[:-1])), *lists, pa.array(packed, pa.binary())], names=["block", "ids", "train", "sizes", "packed"])

    return dealt.mapInArrow(run, f"block int, ids array<{kind}>, train array<boolean>, sizes array<int>, packed binary")


def _flat(group: pa.Table, name: str) -> pa.ChunkedArray:
    return pa.chunked_array([c.flatten() for c in group.column(name).chunks], group.schema.field(name).type.value_type)


def _unpacked_texts(group: pa.Table) -> list[str]:
    out = []
    for sizes, packed in zip(group.column("sizes").to_pylist(), group.column("packed").to_pylist()):
        ends = np.cumsum(sizes).tolist()
        raw = pa.decompress(packed, ends[-1], "zstd", asbytes=True) if ends[-1] else b""
        out += [raw[b - n : b].decode() for b, n in zip(ends, sizes)]
    return out


def score(docs: DataFrame, train, order: int = ORDER, weight: float = WEIGHT, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``train`` is a boolean column: the rows to learn from. Null and empty texts are one end token.
    Without training rows every token is unknown. Repeated rows count as often as they stand. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = n_buckets = max(parts, -(-size // block_bytes))
    tokens, distinct, documents = training_totals(slim, n_buckets)
    # By id and text, so that a block is the same set of rows whenever it is read.
    dealt = _in_blocks(slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int")), kind)

    def made(group: pa.Table) -> tuple[pa.Table, Block, np.ndarray]:
        # In an order of their own, as the pieces of a block come in any.
        group = group.take(pa.array(sorted(range(group.num_rows), key=group.column("packed").to_pylist().__getitem__)))
        return group, Block(_unpacked_texts(group), order), _flat(group, "train").to_numpy(zero_copy_only=False)

    def layout(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n-grams in the order of their hashes (ranges of which are the buckets), the hashes, the buckets that hold any, and where each begins."""
        keys = block.keys(order)
        place = np.argsort(keys).astype(np.int32)
        keys = keys[place]
        return place, keys, *_buckets(keys, n_buckets)

    def ask(group: pa.Table) -> pa.Table:
        group, block, used = made(group)
        place, keys, held, cuts = layout(block)
        counts = np.concatenate(block.counts(used))[place]
        return pa.table(
            {
                "bucket": pa.array(held),
                "block": pa.array(np.full(len(held), group.column("block")[0].as_py(), np.int32)),
                "keys": pa.array([_packed(keys[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                "counts": pa.array([_planes(counts[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                "n": pa.array(np.diff(cuts), pa.int64()),
            }
        )

    asked = dealt.groupBy("block").applyInArrow(ask, "bucket int, block int, keys binary, counts binary, n long")

    def answer(group: pa.Table) -> pa.Table:
        lengths = group.column("n").to_pylist()
        keys = np.concatenate([_unpacked(k, n) for k, n in zip(group.column("keys").to_pylist(), lengths)])
        counts = np.concatenate([_values(c, n) for c, n in zip(group.column("counts").to_pylist(), lengths)]).astype(np.int64)
        distinct_keys, inverse = np.unique(keys, return_inverse=True)
        del keys
        total = np.bincount(inverse, counts, len(distinct_keys)).astype(np.int64)
        # What the other blocks add to a block's own counts, which is often nothing.
        others, cuts = total[inverse] - counts, np.append(0, np.cumsum(lengths))
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "others": pa.array([_planes(others[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())})

    answers = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, others binary")

    def finish(group: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        group, block, used = made(group)
        replies = replies.sort_by("bucket")
        place, _, held, cuts = layout(block)
        if not np.array_equal(held, replies.column("bucket").to_numpy()):
            raise RuntimeError("a block lacks answers; the input isn't the same when it is read again")
        totals = np.concatenate(block.counts(used))
        totals[place] += np.concatenate([_values(o, n) for o, n in zip(replies.column("others").to_pylist(), np.diff(cuts).tolist())]).astype(np.int64)
        counts = np.split(totals, np.cumsum([len(h) for h in block.hashes])[:-1])
        del place, replies
        automaton = Automaton(counts, block, tokens, distinct, documents, weight)
        starts = block.ends - block.lengths
        add = lambda values: np.add.reduceat(values, starts) if len(starts) else values[:0]
        columns = [
            _flat(group, "ids"),
            _flat(group, "train"),
            pa.array(block.lengths),
            pa.array(add((counts[0] > 0)[block.grams[0]].astype(np.int64))),
            pa.array(np.full(len(starts), tokens, np.int64)),
            pa.array(add(automaton.weight[: len(counts[0])][block.grams[0]])),
            pa.array(automaton.scores()),
        ]
        return pa.table(dict(zip(names, columns)))

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        finish, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op8_language_model(spark, sf_dir):
    """Every document under the model of those whose remainder modulo 7 is not 2."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    held = crc_remainder(docs["doc_id"], 7) == 2
    return score(docs, ~held).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
