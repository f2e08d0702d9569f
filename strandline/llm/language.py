"""Language of a text, word by word with backoff to character n-grams.

A known word scores by its log relative frequency in each language. An unknown one is cut into
character n-grams of the longest length that has any known one, from ``MOST`` down to single
characters, and scores by their mean. A text goes to the language with the best mean over its words.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, hash_fraction, slices, spread, table, texts, widened

#: Longest n-gram; documents of each language to learn from, at most about.
MOST, SAMPLE_ROWS = 5, 1500
#: Words and n-grams seen fewer times in the sample are left out.
LEAST = 2
#: What a word or n-gram costs in a language that hasn't it, in powers of ten.
PENALTY = 7.0
#: Unknown words whose n-grams a worker keeps, at most; beyond, they are looked up anew.
UNKNOWN_KEPT = 100_000
#: Counts that a task holds while it learns; beyond, it hands them on.
COUNTED = 300_000

WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters, in lower case. Fractions, raised digits and Roman numerals are no letters."""
    found = WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


class Languages:
    """log10 frequencies by language of words and, by length, of n-grams."""

    def __init__(self, names: list[str], grams: list[str], kinds: np.ndarray, counts: np.ndarray):
        """``kinds``: 0 for words, n for n-grams; ``counts``: one row per gram, one column per language."""
        row, lang = np.nonzero(counts)
        self._fill(names, grams, kinds, np.bincount(row, minlength=len(grams)), lang, counts[row, lang])

    @classmethod
    def sparse(cls, names: list[str], grams: list[str], kinds: np.ndarray, lengths: np.ndarray, lang: np.ndarray, n: np.ndarray) -> Languages:
        """From the counts above zero alone: ``lengths`` of them for each gram, with their languages."""
        model = cls.__new__(cls)
        model._fill(names, grams, kinds, lengths, lang, n)
        return model

    def _fill(self, names: list[str], grams: list[str], kinds: np.ndarray, lengths: np.ndarray, lang: np.ndarray, n: np.ndarray) -> None:
        self.names = names
        of = np.repeat(kinds, lengths).astype(np.int64)
        totals = np.zeros((MOST + 1, len(names)))
        np.add.at(totals, (of, lang), n)
        #: Entry k says that the gram whose range of starts holds k has ``above[k]`` more than the penalty in ``lang[k]``.
        self.starts = np.append(0, np.cumsum(lengths)).astype(np.int64)
        self.lang = np.asarray(lang, np.int32)
        self.above = np.log10(n) - np.log10(totals[of, lang]) + PENALTY
        self.tables: list[dict[str, int]] = [{} for _ in range(MOST + 1)]
        for i, (g, k) in enumerate(zip(grams, kinds.tolist())):
            self.tables[k][g] = i
        self.unknown: dict[str, tuple[int, ...]] = {}

    @property
    def logs(self) -> np.ndarray:
        """All values as a table of grams and languages, and a last row for what isn't known."""
        full = np.full((len(self.starts), len(self.names)), -PENALTY)
        full[np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), self.lang] += self.above
        return full

    def total(self, ids: list[int], weights: list[float] | None = None) -> np.ndarray:
        """The sum of some grams' values by language, each multiplied by its weight, above the penalty."""
        ids = np.array(ids, np.int64)
        first, n = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        values = self.above[at] if weights is None else self.above[at] * np.repeat(weights, n)
        return np.bincount(self.lang[at], values, len(self.names))

    def parts(self, word: str) -> tuple[int, ...]:
        """The known n-grams of a word that isn't known, of the longest length that has any."""
        found = self.unknown.get(word)
        if found is None:
            padded, found = f" {word} ", ()
            for n in range(min(MOST, len(padded)), 0, -1):
                known, border = self.tables[n].get, n == 1
                found = tuple([i for at in range(border, len(padded) - n + 1 - border) if (i := known(padded[at : at + n])) is not None])
                if found:
                    break
            if len(self.unknown) >= UNKNOWN_KEPT:
                self.unknown.clear()
            self.unknown[word] = found
        return found

    def backoff(self, word: str) -> np.ndarray:
        """Scores of a word that isn't known: the mean of its n-grams' values."""
        found = self.parts(word)
        return self.total(found) / max(len(found), 1) - PENALTY

    def predict(self, text: str) -> tuple[str, float]:
        """Language and score: one minus the ratio of the second language's mean likelihood to the first's.

        ``und`` if the text has no letter or nothing was learned; a score of 0 if no word has evidence.
        """
        found = words(text)
        if not found or not self.names:
            return "und", 0.0
        ids = list(map(self.tables[0].get, found))
        total = self.total([i for i in ids if i is not None])
        if None in ids:
            grams, weights = [], []
            for w, n in Counter(w for w, i in zip(found, ids) if i is None).items():
                if hits := self.parts(w):
                    grams += hits
                    weights += [n / len(hits)] * len(hits)
            total = total + self.total(grams, weights)
        mean = total / len(found) - PENALTY
        order = np.argsort(-mean, kind="stable")
        second = mean[order[1]] if len(order) > 1 else -PENALTY
        return self.names[order[0]], float(1 - 10 ** min(second - mean[order[0]], 0.0))


def _grams(text: str) -> Counter:
    """(kind, gram) of a text's words."""
    seen: Counter = Counter()
    for w, c in Counter(words(text)).items():
        seen[0, w] += c
        padded = f" {w} "
        for n in range(1, min(MOST, len(padded)) + 1):
            for at in range(n == 1, len(padded) - n + 1 - (n == 1)):  # a border alone is no gram
                seen[n, padded[at : at + n]] += c
    return seen


def learn(docs: DataFrame, train: Column | None = None, sample_rows: int = SAMPLE_ROWS, least: int = LEAST) -> Languages:
    """Counts of about ``sample_rows`` documents of each language, chosen by a hash of id and text.

    Every language is learned. Ids are whole numbers. The sample bounds the model, which goes to the driver and to every worker.
    """
    ready = docs.filter(docs["lang"].isNotNull() & docs["doc_id"].isNotNull() & docs["text"].isNotNull() & (F.lit(True) if train is None else train))
    ready = ready.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], docs["lang"])
    sizes = ready.groupBy("lang").count().collect()
    names = sorted(r["lang"] for r in sizes)
    if not names:
        return Languages([], [], np.zeros(0, np.int64), np.zeros((0, 0)))
    share = {r["lang"]: min(1.0, sample_rows / r["count"]) for r in sizes}
    limits = docs.sparkSession.createDataFrame(list(share.items()), "lang string, share double")
    sample = ready.join(F.broadcast(limits), "lang").filter(hash_fraction(F.col("doc_id")) < F.col("share"))
    place = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for lang in list(seen):
                c = seen.pop(lang)
                if c:
                    kinds, grams = zip(*c)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([place[lang]] * len(c), pa.int32()), pa.array(kinds, pa.int32()), pa.array(grams, pa.string()), pa.array(list(c.values()), pa.int64())],
                        names=["lang", "kind", "gram", "n"],
                    )

        for batch in slices(batches, 8 << 20):
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch)):
                seen[lang].update(_grams(text))
            if sum(map(len, seen.values())) > COUNTED:
                yield from rows()
        yield from rows()

    counted = sample.select("lang", "text").mapInArrow(count, "lang int, kind int, gram string, n long")
    each = counted.groupBy("kind", "gram", "lang").agg(F.sum("n").alias("n"))
    whole = each.groupBy("kind", "gram").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")).filter(F.col("all") >= least)
    rows = whole.select("kind", "gram", F.col("by.lang").alias("lang"), F.col("by.n").alias("n")).toArrow().sort_by([("kind", "ascending"), ("gram", "ascending")]).combine_chunks()
    flat = lambda name: pa.concat_arrays([c.flatten() for c in rows.column(name).chunks]).to_numpy() if rows.num_rows else np.zeros(0, int)
    lengths = np.concatenate([c.value_lengths().to_numpy() for c in rows.column("lang").chunks]) if rows.num_rows else np.zeros(0, int)
    return Languages.sparse(names, rows.column("gram").to_pylist(), rows.column("kind").to_numpy().astype(np.int64), lengths, flat("lang"), flat("n"))


def identify(docs: DataFrame, model: Languages) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (columns of these names are replaced).

    Whole texts are read. A null text, or one without a letter, is ``und`` with score 0. Repeated rows
    get equal answers; an empty table gives an empty result. Ties go to the first language by name.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, 8 << 20):
            found = [own.predict(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(run, widened(docs.schema, ("lang_pred", "string"), ("score", "double")))


def recognised(docs: DataFrame, model: Languages) -> DataFrame:
    """The rows of ``docs`` whose text has letters and evidence for some language, columns unchanged.

    Only texts go to Python and only truth values come back; the other columns stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            # A score above zero goes to a language alone, never to ``und``. One text at a time is made a string.
            yield pa.array((own.predict(t.as_py() or "")[1] > 0 for t in batch), pa.bool_())

    return docs.filter(known(docs["text"]))


def op2_language(spark, sf_dir):
    """Language of every document, learned where crc32(doc_id) modulo 4 isn't 2."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    model = learn(docs, crc_remainder(docs["doc_id"], 4) != 2)
    return identify(docs.drop("lang"), model).select("doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
