"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token the last token of its encoding is unique. A suffix automaton reads the
pre-token once from left to right; its state stands for the longest run of the last bytes that begins
any token, and its suffix links yield the tokens that end there, the longest first. The first one whose
neighbour (the last token of the prefix before it) is compatible is stored, and back-pointers from the
end give the ids. Two tokens are compatible if no merge across their border would have come before the
merges that built them, which is found by undoing those merges from the latest on.

Pre-tokens that a worker hasn't met are read side by side, a byte of each at a time, as columns of states and
last tokens; very long ones are read alone, by the same steps.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, spread, table, texts, widened

#: Entries that a worker keeps of words and of token pairs; beyond, older ones are worked out anew.
WORDS_KEPT, PAIRS_KEPT = 200_000, 400_000
#: Slots of a worker's tables of transitions and pairs; characters of a word that is kept; how many words are looked
#: up, and how many are read, together; fewer than ``FEW`` are read alone.
SLOTS, LONGEST, TOGETHER, SIDE_BY_SIDE, FEW = 1 << 19, 64, 1 << 18, 1 << 14, 300

#: Ranges of characters in which the fast splitter and the library's own agree on letters and digits.
COMMON = r"\x00-՗ -⁯぀-ゔァ-ヺ一-龥가-힣"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write byte b as a printable character; its byte by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        table = str.maketrans(letters)
        vocab = spec["model"]["vocab"]
        raw = {token: token.translate(table).encode("latin-1") for token in vocab}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        singles = sorted((t for t in vocab if len(t) == 1), key=vocab.get)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # Ranks: single bytes first, then merges in their order.
        rank = {t: i for i, t in enumerate(singles)}
        self.left, self.right = list(range(len(singles))), list(range(len(singles)))
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            r = len(self.left)
            if a + b in rank:
                continue
            rank[a + b] = r
            self.left.append(rank[a])
            self.right.append(rank[b])
            self.joined[rank[a], rank[b]] = r
        self.ids = [0] * len(rank)
        self.lengths = [0] * len(rank)
        # Suffix automaton: (state, byte) to state, each state's suffix link, the longest token that ends in a
        # state, and the longest token that ends another token.
        self.step: dict[int, int] = {}
        depth, end_of, step = [0], [0] * len(rank), self.step
        for token, r in rank.items():
            self.ids[r] = vocab[token]
            self.lengths[r] = len(token)
            state = 0
            for byte in raw[token]:
                at = state << 8 | byte
                after = step.get(at)
                if after is None:
                    after = step[at] = len(depth)
                    depth.append(depth[state] + 1)
                state = after
            end_of[r] = state
        if sum(at < 256 for at in self.step) < 256:
            raise ValueError("a byte-level vocabulary has a token for every byte")
        self.link, self.token_at = array("i", [0] * len(depth)), array("i", [-1] * len(depth))
        for r, state in enumerate(end_of):
            self.token_at[state] = r
        for at, state in sorted(self.step.items(), key=lambda e: depth[e[1]]):
            before = at >> 8
            if before:
                self.link[state] = self.follow(self.link[before], at & 255)
                if self.token_at[state] < 0:
                    self.token_at[state] = self.token_at[self.link[state]]
        self.ending = array("i", [self.token_at[self.link[state]] if depth[state] > 1 else -1 for state in end_of])
        size = max(*vocab.values(), *self.special.values(), 0) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = raw[token]
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.decimal = [str(i) for i in range(size)]
        # The vocabulary's split pattern, for texts of common characters alone.
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
        self.uncommon = re.compile(f"[^{COMMON}]")
        self.gap = re.compile(r"[ \n]{2}")
        self.library_split = Tokenizer.from_file(path).pre_tokenizer
        self.around_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.columns = Columns(self) if max(len(depth), len(rank)) <= Table.MOST else None
        self.pairs: dict[int, bool] = {}
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.words_before: dict[str, tuple[int, ...]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether token ``a`` followed by ``b`` is how their joined bytes are encoded."""
        joined, left, right = self.joined, self.left, self.right
        before = 1 << 30  # merges across the border matter only if they come before this rank
        while True:
            if joined.get((a, b), before) < before:
                return False
            for side in ("a", "b") if a > b else ("b", "a"):
                if side == "a":
                    inner = right[a]
                    if inner != a:
                        before, a = a, inner
                        break
                else:
                    inner = left[b]
                    if inner != b:
                        before, b = b + 1, inner
                        break
            else:
                return True

    def follow(self, state: int, byte: int) -> int:
        """The state after a byte; suffix links are followed until a state goes on with it (the first one does with any)."""
        after = self.step.get(state << 8 | byte)
        while after is None:
            state = self.link[state]
            after = self.step.get(state << 8 | byte)
        return after

    def word(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        s = piece.encode()
        n = len(s)
        last, pairs, lengths, step, token_at, ending = [0] * (n + 1), self.pairs, self.lengths, self.step.get, self.token_at, self.ending
        state = end = 0
        for byte in s:
            end += 1
            after = step(state << 8 | byte)
            state = self.follow(self.link[state], byte) if after is None else after
            t = token_at[state]
            while start := end - lengths[t]:
                key = last[start] << 24 | t
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= PAIRS_KEPT:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(last[start], t)
                if fits:
                    break
                t = ending[t]
                if t < 0:
                    raise ValueError("no token fits; the merges don't build the vocabulary")
            last[end] = t
        out, ids = [], self.ids
        while n:
            t = last[n]
            out.append(ids[t])
            n -= lengths[t]
        return tuple(reversed(out))

    def kept(self, piece: str) -> tuple[int, ...]:
        """Ids of one pre-token, worked out once while it is kept."""
        ids = self.young.get(piece) or self.old.get(piece) or self.word(piece)
        if len(piece) <= LONGEST:
            self.young[piece] = ids
            if len(self.young) > WORDS_KEPT:
                self.young, self.old = {}, self.young
        return ids

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, some: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text; what they have of new words is read together."""
        begun: list[list[int]] = []
        waiting: list[tuple[list[int], str, list]] = []
        size = 0
        for text in some:
            ids: list[int] = []
            begun.append(ids)
            for kind, found in self.parts(text):
                for at in range(0, len(found), TOGETHER):
                    waiting.append((ids, kind, found[at : at + TOGETHER]))
                    size += len(waiting[-1][2])
                    if size >= TOGETHER:
                        self.settle(waiting)
                        yield from begun[:-1]
                        begun, waiting, size = begun[-1:], [], 0
        self.settle(waiting)
        yield from begun

    def parts(self, text: str) -> Iterator[tuple[str, list]]:
        """A text as ``ids``, ``pieces`` (pre-tokens) and ``runs``, which have a blank before each, in their order."""
        if any(s in text for s in self.special):
            for p in self.around_special.split(text):
                if p in self.special:
                    yield "ids", [self.special[p]]
                elif p:
                    yield from self.plain_parts(p)
        else:
            yield from self.plain_parts(text)

    def plain_parts(self, text: str) -> Iterator[tuple[str, list]]:
        if self.uncommon.search(text):
            yield "pieces", [text[a:b] for _, (a, b) in self.library_split.pre_tokenize_str(text)]
        elif self.gap.search(text):
            yield "pieces", self.split.findall(text)
        else:
            # With single gaps alone, a line feed is a pre-token and every blank begins one: each run between
            # blanks of a line stands alone.
            for n, line in enumerate(text.split("\n")):
                first, *runs = line.split(" ")
                yield "pieces", ["\n"] * (n > 0) + self.split.findall(first)
                yield "runs", runs

    def settle(self, waiting: list[tuple[list[int], str, list]]) -> None:
        """Add the ids of each part to its list."""
        self.learn(*(set().union(*(found for _, k, found in waiting if k == kind)) for kind in ("runs", "pieces")))
        for ids, kind, found in waiting:
            if kind == "runs":
                known = list(map(self.words.get, found))
                if None in known:
                    known = [self.spaced(r) if i is None else i for r, i in zip(found, known)]
                ids += chain.from_iterable(known)
            elif kind == "pieces":
                ids += chain.from_iterable(map(self.kept, found))
            else:
                ids += found

    def learn(self, runs: set[str], pieces: set[str]) -> None:
        """Keep the ids of new runs and pre-tokens."""
        if len(self.young) > WORDS_KEPT:
            self.young, self.old = {}, self.young
        if len(self.words) > WORDS_KEPT:
            self.words, self.words_before = {}, self.words
        new = [r for r in runs.difference(self.words, self.words_before) if len(r) <= LONGEST]
        cut = [self.split.findall(" " + r) for r in new]
        fresh = [p for p in pieces.union(*cut).difference(self.young, self.old) if len(p) <= LONGEST]
        if self.columns is not None and len(fresh) >= FEW:
            self.young.update(zip(fresh, self.columns.words(fresh)))
        words, kept = self.words, self.kept
        for r, found in zip(new, cut):
            words[r] = kept(found[0]) if len(found) == 1 else tuple(chain.from_iterable(map(kept, found)))

    def pieces_of(self, run: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.kept, self.split.findall(run))))

    def spaced(self, word: str) -> tuple[int, ...]:
        """Ids of a blank and the run after it."""
        ids = self.words.get(word) or self.words_before.get(word) or self.pieces_of(" " + word)
        if len(word) <= LONGEST:
            self.words[word] = ids
            if len(self.words) > WORDS_KEPT:
                self.words, self.words_before = {}, self.words
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Table:
    """Results by key as columns: a key's slot holds it with its result until another key comes, and what isn't there is worked out.

    Keys are below 2^42, results below ``MOST``; larger vocabularies are read word by word.
    """

    MOST = 1 << 20

    def __init__(self, work_out: Callable[[np.ndarray], np.ndarray]):
        self.work_out, self.slots = work_out, np.full(SLOTS, -1, np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = (keys * 0x9E3779B1 >> 13) & (SLOTS - 1)
        kept = self.slots[at]
        miss = np.flatnonzero(kept >> 20 != keys)
        if miss.size:
            new = np.unique(keys[miss])
            results = self.work_out(new)
            self.slots[(new * 0x9E3779B1 >> 13) & (SLOTS - 1)] = new << 20 | results
            kept[miss] = results[np.searchsorted(new, keys[miss])]
        return kept & ((1 << 20) - 1)


class Sorted:
    """A dict of whole numbers as sorted columns."""

    def __init__(self, keys: Iterable[int], values: Iterable[int]):
        self.keys, self.values = np.fromiter(keys, np.int64), np.fromiter(values, np.int64)
        order = np.argsort(self.keys)
        self.keys, self.values = self.keys[order], self.values[order]

    def get(self, keys: np.ndarray, default: int) -> np.ndarray:
        if not self.keys.size:
            return np.full(keys.size, default)
        at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
        return np.where(self.keys[at] == keys, self.values[at], default)


class Columns:
    """The steps of ``PrefixBpe.word`` for many pre-tokens at a time."""

    def __init__(self, bpe: PrefixBpe):
        self.step = Sorted(bpe.step.keys(), bpe.step.values())
        self.joined = Sorted((a << 21 | b for a, b in bpe.joined), bpe.joined.values())
        self.link, self.token_at, self.ending = (np.array(a, np.int64) for a in (bpe.link, bpe.token_at, bpe.ending))
        self.lengths, self.left, self.right = (np.array(a, np.int64) for a in (bpe.lengths, bpe.left, bpe.right))
        self.ids = np.array(bpe.ids, np.int64)
        self.after, self.fits = Table(self.follow), Table(self.compatible)

    def follow(self, keys: np.ndarray) -> np.ndarray:
        """States after (state, byte), by suffix links."""
        state, byte, out = keys >> 8, keys & 255, np.full(keys.size, -1)
        left = np.arange(keys.size)
        while left.size:
            after = self.step.get(state[left] << 8 | byte[left], -1)
            out[left] = after
            left = left[after < 0]
            state[left] = self.link[state[left]]
        return out

    def compatible(self, keys: np.ndarray) -> np.ndarray:
        """Whether pairs of tokens stand, 0 or 1; see ``PrefixBpe.compatible``."""
        a, b, out = keys >> 21, keys & ((1 << 21) - 1), np.zeros(keys.size, np.int64)
        at, before = np.arange(keys.size), np.full(keys.size, 1 << 30)
        while at.size:
            going = self.joined.get(a << 21 | b, 1 << 30) >= before
            a, b, at, before = a[going], b[going], at[going], before[going]
            inner_a, inner_b = self.right[a], self.left[b]
            by_a = (inner_a != a) & ((a > b) | (inner_b == b))
            by_b = (inner_b != b) & ~by_a
            going = by_a | by_b
            out[at[~going]] = 1
            before = np.where(by_a, a, b + 1)[going]
            a, b, at = np.where(by_a, inner_a, a)[going], np.where(by_b, inner_b, b)[going], at[going]
        return out

    def words(self, pieces: list[str]) -> Iterator[tuple[int, ...]]:
        """Ids of each pre-token, in their order."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        encoded = [p.encode() for p in pieces]
        by_length = sorted(range(len(pieces)), key=lambda i: len(encoded[i]), reverse=True)
        for at in range(0, len(by_length), SIDE_BY_SIDE):
            some = by_length[at : at + SIDE_BY_SIDE]
            for i, ids in zip(some, self.block([encoded[i] for i in some])):
                out[i] = ids
        return iter(out)

    def block(self, words: list[bytes]) -> Iterator[tuple[int, ...]]:
        """Ids of words, the longest first."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        last = np.zeros((int(sizes[0]) + 1, len(words)), np.int32)
        state = np.zeros(len(words), np.int64)
        for end in range(1, int(sizes[0]) + 1):
            n = int(np.searchsorted(-sizes, -end, "right"))  # words that have this byte
            state = self.after[state[:n] << 8 | text[begin[:n] + (end - 1)]]
            token = self.token_at[state]
            start = end - self.lengths[token]
            open_ = np.flatnonzero(start)
            while open_.size:
                fits = self.fits[last[start[open_], open_].astype(np.int64) << 21 | token[open_]]
                open_ = open_[fits == 0]
                shorter = self.ending[token[open_]]
                if (shorter < 0).any():
                    raise ValueError("no token fits; the merges don't build the vocabulary")
                token[open_] = shorter
                start[open_] = end - self.lengths[shorter]
                open_ = open_[start[open_] > 0]
            last[end, :n] = token
        # Back-pointers from the ends: one more token of every word at a time.
        found, owner = [], []
        at, left = sizes, np.arange(len(words))
        while left.size:
            token = last[at, left]
            found.append(self.ids[token])
            owner.append(left)
            at = at - self.lengths[token]
            left, at = left[at > 0], at[at > 0]
        owners = np.concatenate(owner[::-1])
        ids = np.concatenate(found[::-1])[np.argsort(owners, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(owners, minlength=len(words))).tolist()
        return (tuple(ids[a:b]) for a, b in zip([0, *ends], ends))


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixBpe:
    """One encoder per task and file."""
    return PrefixBpe(path)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The file of a name, or the name itself if it is an absolute path."""
    if name.startswith("/"):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, text_col: str = "text", name: str = "byte_bpe_50k.json") -> DataFrame:
    """Add ``token_ids`` (array<int>), replacing a column of that name; a null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary_path(name))
        for batch in slices(batches, 8 << 20):
            ids = list(bpe.encode_all(texts(batch, text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "token_ids"])
        encoder.cache_clear()  # a worker would else hold it while it does other work

    docs = docs.drop("token_ids")
    return docs.mapInArrow(run, widened(docs.schema, ("token_ids", "array<int>")))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k.json") -> DataFrame:
    """Ids and decoded text of every document, as counts and digests; only these leave the workers.

    Null and empty texts have no tokens and the digest of the empty string. Rows stay one to one, so
    repeated rows, null ids and extra columns change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary_path(name))
        decimal = bpe.decimal.__getitem__
        for batch in slices(batches, 8 << 20):
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_all(texts(batch, "text")):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        encoder.cache_clear()  # a worker would else hold it while it does other work

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark, sf_dir):
    """n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return digests(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
