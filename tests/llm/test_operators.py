"""The ten operators against plain Python, and their defined results for odd rows."""

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import bpe, language, language_model, lines, media, quality, simhash, tiling, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string"
WORDS = "the of and to in river stone house light water green field open letter market window story quiet".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(5)
    long = "\n".join(prose(rng, 40) for _ in range(2500))
    rows = [
        (1, "the river and the stone", "en", "a", 23, 0.1, "x"),
        (1, "the river and the stone", "en", "a", 23, 0.1, "x"),
        (2, None, "en", "b", None, None, None),
        (3, "", "fr", "c", 0, 0.5, "y"),
        (None, "the river and the stone", None, None, None, None, None),
        (4, long, "en", "d", len(long), 0.2, "z"),
        (5, " \n\t ", None, "a", 4, None, None),
        (6, "1234 !!! 你好 😀", "en", None, 12, None, None),
        (7, "the river and the stone", "en", "e", 23, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


def none(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int, text string"


def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0, None), (3, 0, None, None), (4, 1, 1, None), (None, 1, 0, None), (7, None, 0, None), (7, 1, 0, None), (99, 0, 0, None)], LABELS)


# 1, 6: classifiers


def labelled(spark, n=240):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        kind = i % 3
        text = prose(rng, rng.randint(4, 60))
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 1 and i % 2:
            words = text.split()
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), rng.choice(["wretch", "dunce"]))
            text = " ".join(words)
        docs.append((i, text, "en", "s", len(text), None, None))
        labels.append((i, int(kind != 0), int(kind == 1 and i % 2 == 1), None))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    model = quality.learn(docs, labels, F.col("doc_id") % 4 != 2)
    rows = quality.score(docs, model).join(labels.drop("text"), "doc_id").filter("doc_id % 4 = 2").collect()
    assert len(rows) == 60 and all(0 <= r["score"] <= 1 for r in rows)
    assert sum((r["score"] >= 0.7) == bool(r["quality"]) for r in rows) >= 57
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_odd_rows(spark):
    model = quality.learn(odd_docs(spark), odd_labels(spark))
    rows = quality.score(odd_docs(spark), model).collect()
    assert len(rows) == 9 and all(r["score"] is not None for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    empty = quality.learn(none(spark), odd_labels(spark))
    assert {r["score"] for r in quality.score(odd_docs(spark), empty).collect()} == {0.5}
    assert quality.score(none(spark), model).count() == 0
    one = quality.learn(odd_docs(spark), odd_labels(spark).filter("quality = 1"))
    assert len({r["score"] for r in quality.score(odd_docs(spark), one).collect()}) == 1


def test_dual_coordinate_descent_separates():
    from strandline.llm.linear import Rows, dual_coordinate_descent

    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 80)
    rows = [np.unique(np.append(rng.integers(2, 40, 5), v)) for v in y]
    w, b = dual_coordinate_descent(Rows(rows), np.ones(40), y, np.full(80, 10.0), 50)
    assert all((w[r].sum() / math.sqrt(len(r)) + b > 0) == bool(v) for r, v in zip(rows, y))


def test_toxicity_chain(spark):
    docs, labels = labelled(spark, 960)
    categories = {"p_low": F.col("quality") == 0, "p_named": (F.col("toxic") == 1) & (F.col("doc_id") % 2 == 1), "p_toxic": F.col("toxic") == 1}
    chain = toxicity.learn(docs, labels, categories, F.col("doc_id") % 4 != 3)
    rows = toxicity.score(docs, chain, list(categories)).join(labels.drop("text"), "doc_id").filter("doc_id % 4 = 3").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= len(rows) - 2
    assert any(np.abs(v).max() > 0.05 for _, v, _ in chain.models[1:])  # earlier probabilities are used


def test_toxicity_odd_rows(spark):
    categories = {"low": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    chain = toxicity.learn(odd_docs(spark), odd_labels(spark), categories)
    rows = toxicity.score(odd_docs(spark), chain, list(categories)).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    bare = toxicity.learn(none(spark), odd_labels(spark), categories)
    assert {r["predicted"] for r in toxicity.score(odd_docs(spark), bare, list(categories)).collect()} == {0}
    assert toxicity.score(none(spark), chain, list(categories)).count() == 0


# 2: language


def test_language_backoff(spark):
    rng = random.Random(2)
    parts = {"aa": ["bata", "kuta", "motu", "sata"], "bb": ["grish", "plosh", "tresh", "brosh"]}
    rows = [(i, " ".join(rng.choice(parts[g]) for _ in range(30)), g, "s", 0, None, None) for i in range(60) for g in ("aa", "bb")]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.learn(docs)
    asked = spark.createDataFrame([(1, "Bata motu"), (2, "grishplo"), (3, "kutamo"), (4, None), (5, "12 %"), (6, "你")], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(asked, model).collect()}
    assert [found[i][0] for i in (1, 2, 3, 4, 5)] == ["aa", "bb", "aa", "und", "und"]
    assert found[6] == ("aa", 0.0) and found[4][1] == 0.0  # a letter, but no evidence: the first by name
    kept = language.recognised(asked, model)
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3} and kept.columns == asked.columns


def test_language_learns_every_language(spark):
    """More languages than any fixed number of them, each with words of its own."""
    rows = [(3 * k + i, " ".join(f"{chr(0x4E00 + k)}{chr(0x6000 + 7 * k + j)}" for j in range(4)), f"l{k:03}") for k in range(230) for i in range(1 + (k < 200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert len(model.names) == 230
    assert all(r["lang"] == r["lang_pred"] for r in language.identify(docs, model).collect())


def test_language_word_scores():
    model = language.Languages(["x", "y"], ["ab", "a", "b"], np.array([0, 1, 1]), np.array([[4, 1], [3, 0], [1, 5]]))
    assert np.allclose(model.logs[0], [0.0, 0.0])
    assert np.allclose(model.backoff("ba"), (model.logs[1] + model.logs[2]) / 2)


def brute_language(learned, text):
    """Mean log10 frequencies over a text's words, from counts in plain dictionaries."""
    counts = defaultdict(Counter)
    for t, lang in learned:
        for w in "".join(c if c.isalpha() else " " for c in t.lower()).split():
            counts[lang, 0][w] += 1
            for n in range(1, language.MOST + 1):
                padded = w if n == 1 else f" {w} "
                counts[lang, n].update(padded[i : i + n] for i in range(len(padded) - n + 1))
    names = sorted({lang for lang, _ in counts})
    known = {(n, g) for n in range(language.MOST + 1) for g in {g for lang in names for g in counts[lang, n]} if sum(counts[lang, n][g] for lang in names) >= language.LEAST}

    def value(lang, n, g):
        c = counts[lang, n][g]
        return math.log10(c / sum(counts[lang, n][x] for x in counts[lang, n] if (n, x) in known)) if c else -language.PENALTY

    total, words = dict.fromkeys(names, 0.0), "".join(c if c.isalpha() else " " for c in text.lower()).split()
    for w in words:
        parts = [(0, w)] if (0, w) in known else []
        for n in range(language.MOST, 0, -1):
            padded = w if n == 1 else f" {w} "
            parts = parts or [(n, padded[i : i + n]) for i in range(len(padded) - n + 1) if (n, padded[i : i + n]) in known]
        for lang in names:
            total[lang] += sum(value(lang, n, g) for n, g in parts) / len(parts) if parts else -language.PENALTY
    if not words or not names:
        return "und", 0.0
    order = sorted(names, key=lambda x: (-round(total[x], 9), x))
    second = total[order[1]] if len(order) > 1 else -language.PENALTY * len(words)
    return order[0], 1 - 10 ** min((second - total[order[0]]) / len(words), 0.0)


def test_language_equals_brute_force(spark):
    rng = random.Random(15)
    parts = {"aa": "ba ta ku mo sa ri", "bb": "gri plo tre sh bro sa", "cc": "né ça où mo ri lé"}
    word = lambda g: "".join(rng.choice(parts[g].split()) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word(g) for _ in range(rng.randint(0, 12))), g) for i in range(30) for g in parts]
    asked = [" ".join(word(g) for _ in range(rng.randint(0, 8))) for g in parts for _ in range(30)] + ["", "½ ² Ⅷ", "1½ba 2²", "zzz", "Ba½TA", "x"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    want = [brute_language([(t, g) for _, t, g in rows], t) for t in asked]
    for (lang, score), t in zip(want, asked):
        got = model.predict(t)
        assert got[0] == lang and math.isclose(got[1], score, abs_tol=1e-9), (t, got, lang, score)
    assert {model.predict(t)[0] for t in ("½", "²", "1½ 2²", "Ⅷ")} == {"und"}


def test_language_odd_rows(spark):
    model = language.learn(odd_docs(spark))
    out = language.identify(odd_docs(spark), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "predicted", "lang_pred", "score"] and out.count() == 9
    assert language.identify(none(spark), model).count() == 0
    bare = language.learn(none(spark))
    assert {r["lang_pred"] for r in language.identify(odd_docs(spark), bare).collect()} == {"und"}


# 3: archives

PAGES = "page_id long, url string, html string, payload string"


def test_warc_round_trip(spark):
    big, other = "x" * 1500 + "é", "y" * 999
    rows = [(1, "u1", big, None), (2, "u2", big, None), (3, None, None, None), (4, "u\r\n4", other, None), (5, "u5", other, None), (6, "u6", big, None), (None, "n", big, None), (7, "u7", "z" * 300_000, None)]
    pages = spark.createDataFrame(rows, PAGES)
    archives = warc.write(warc.with_referrals(pages), 2000)
    got = {r["page_id"]: r for r in warc.read(archives).collect()}
    assert len(got) == 8
    for p, _, html, _ in rows:
        raw = (html or "").encode()
        assert got[p]["payload_bytes"] == len(raw) and got[p]["payload_digest"] == hashlib.sha1(raw).hexdigest()
        assert got[p]["refers_to"] == (6 if html == big and p != 6 else None)
        assert got[p]["record_type"] == ("revisit" if html == big and p != 6 else "response")
        assert got[p]["payload"] == (None if html == big and p != 6 else raw)
    assert warc.read(warc.write(warc.with_referrals(spark.createDataFrame([], PAGES)))).count() == 0


def test_warc_repeated_rows_and_members(spark):
    pages = spark.createDataFrame([(1, "a", "q" * 2000, None), (1, "a", "q" * 2000, None), (1, "a", "w" * 2000, None)], PAGES)
    archive = b"".join(bytes(r["archive"]) for r in warc.write(warc.with_referrals(pages)).collect())
    assert gzip.decompress(archive).count(b"WARC-Type: response") == 3  # rows that repeat the largest id are stored
    found = list(warc.records(iter([archive[i : i + 7] for i in range(0, len(archive), 7)])))
    assert [r["page_id"] for r in found] == [1, 1, 1]
    with pytest.raises(ValueError):
        list(warc.records(iter([archive[:-20]])))
    wrong = warc.record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None)
    with pytest.raises(ValueError):
        list(warc.records(iter([wrong])))


def test_warc_bad_archives_and_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 300, None) for i in range(4)], PAGES)
    good = b"".join(bytes(r["archive"]) for r in warc.write(warc.with_referrals(pages)).collect())
    wrong = warc.record(9, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None)
    bare = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n")
    cells = [good, good[:-20], b"no archive", wrong, bare, None, b"", good]
    archives = spark.createDataFrame([(c,) for c in cells], "archive binary")
    rows = warc.read(archives).collect()
    assert len([r for r in rows if r["error"] is None]) == 4 + 3 + 4 and len([r for r in rows if r["error"]]) == 4
    assert all(r["page_id"] is None for r in rows if r["error"])
    for cell, why in ((good[:-20], "ends inside a record"), (wrong, "payload digest")):
        with pytest.raises(Exception, match=why):
            warc.read(spark.createDataFrame([(cell,)], "archive binary"), strict=True).collect()
    for k, c in enumerate((good, good)):
        (tmp_path / f"{k}.warc.gz").write_bytes(c)
    (tmp_path / "other.txt").write_bytes(b"x")
    found = warc.read_files(spark, str(tmp_path)).collect()
    assert sorted(r["page_id"] for r in found) == [0, 0, 1, 1, 2, 2, 3, 3] and all(r["payload"].decode().startswith("page") for r in found)


# 4: media


@pytest.mark.parametrize("n", [1, 15, 16, 17, 700])
def test_media_round_trip(n):
    payload = random.Random(n).randbytes(192 * n)
    data = media.frames(payload)
    track = media.Track(data)
    assert track.sample_bytes(data) == payload and track.codec == "raw " and track.duration == n / 25
    ranges = track.key_ranges()
    assert ranges == [(32 + 192 * k, 192) for k in range(0, n, 16)]
    kinds = [p for p, _, _ in media.boxes(memoryview(data))]
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in kinds
    with pytest.raises(ValueError):
        list(media.boxes(memoryview(data[:-3])))


def test_media_odd_rows(spark):
    stored = media.store(odd_docs(spark))
    rows = media.digests(stored).collect()
    by = {(r["doc_id"], r["n_bytes"]): r for r in rows}
    assert len(rows) == 9 and by[2, 0]["media_sha256"] == by[3, 0]["media_sha256"]
    for r, raw in ((by[2, 0], b""), (by[1, 23], b"the river and the stone")):
        padded = raw + b" " * (192 - len(raw))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-16:]) and r["payload_bytes"] == 192
    described = media.describe(stored.select("doc_id", "media")).collect()
    assert {r["codec"] for r in described} == {"raw "} and all(r["keyframes"][0]["offset"] == 32 for r in described)
    assert media.digests(media.store(none(spark))).count() == 0


def test_media_bad_cells_and_second_track(spark):
    data = media.frames(bytes(range(192)) * 3)
    cells = [data, data[:-3], b"", b"nothing", None, data[:40]]
    frame = spark.createDataFrame([(i, 1, c) for i, c in enumerate(cells)], "doc_id long, n_bytes long, media binary")
    by = {r["doc_id"]: r for r in media.describe(frame).collect()}
    assert by[0]["n_samples"] == 3 and by[0]["error"] is None and by[4]["error"] is None and by[4]["codec"] is None
    assert all(by[i]["error"] and by[i]["codec"] is None for i in (1, 2, 3, 5))
    digests = {r["doc_id"]: r for r in media.digests(frame).collect()}
    assert digests[0]["payload_sha256"] == hashlib.sha256(bytes(range(192)) * 3).hexdigest() and digests[1]["media_bytes"] == len(data) - 3
    # A second track with tables of its own behind the first one.
    at = data.index(b"moov") - 4
    moov, other = data[at + 8 :], media.frames(bytes(192 * 40))
    second = other[other.index(b"trak") - 4 :]
    both = data[:at] + media._box(b"moov", moov, second)
    assert len(media.Track(both).sizes) == 3 and media.Track(both).sample_bytes(both) == bytes(range(192)) * 3


# 5: tokens


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    own, library = bpe.encoder(path), Tokenizer.from_file(path)
    rng = random.Random(3)
    alphabet = "aabbcdeehtionsTHE   '²\r\t  \n\t'éüñß123.,!&$%*　你好😀́\x00ᯓ꟎߷"
    for k in range(4000):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        s += "<|endoftext|>" + s if k % 40 == 0 else ""
        want = library.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == want, s
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_reads_new_words_side_by_side(monkeypatch):
    """Every new word of a batch, but for very long ones, is read in columns, with the library's ids."""
    from tokenizers import Tokenizer

    rng, file = random.Random(5), bpe.vocabulary_path()
    library = Tokenizer.from_file(file)
    letters = ["abcdefghij", "etaoin", "0123456789", "aé漢字한🙂", "a.,'_-!?", "aaaab", "the and ing er"]
    some = ["".join(rng.choice(rng.choice(letters)) for _ in range(rng.randint(0, 70))) for _ in range(3000)]
    some = ["", " ", *(" ".join(some[i : i + 30]) for i in range(0, 3000, 30)), "x" * 65 + " " + "ab" * 300, "a<|endoftext|>b  c\n\nd", "\n".join(some[:40]), " ".join(some[:900])]
    wanted = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    for slots, together, side in ((bpe.SLOTS, bpe.TOGETHER, bpe.SIDE_BY_SIDE), (64, 700, 50)):
        monkeypatch.setattr(bpe, "SLOTS", slots)
        monkeypatch.setattr(bpe, "TOGETHER", together)
        monkeypatch.setattr(bpe, "SIDE_BY_SIDE", side)
        monkeypatch.setattr(bpe, "FEW", 1)
        own, alone = bpe.PrefixBpe(file), []
        word = own.word
        own.word = lambda piece: alone.append(piece) or word(piece)
        assert list(own.encode_all(some)) == wanted
        assert alone and all(len(p) > bpe.LONGEST for p in alone)


def test_bpe_odd_rows(spark):
    rows = bpe.digests(odd_docs(spark)).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 9 and all(r["ids_sha256"] == nothing and r["n_tokens"] == 0 for r in rows if r["doc_id"] in (2, 3))
    ids = bpe.encode(odd_docs(spark)).collect()
    assert all(",".join(map(str, r["token_ids"])) for r in ids if r["text"])
    assert bpe.digests(none(spark)).count() == 0


# 7: lines


def plain_lines(rows, least):
    """Lines by plain Python: the first occurrence of a line on ``least`` sites or more stays."""
    sites, first = defaultdict(set), {}
    for i, t, s in rows:
        for pos, line in enumerate((t or "").split("\n")):
            if t is not None and line.strip(" "):
                sites[line].add(s or "")
                at = (i is not None, i or 0, pos)
                first[line] = min(first.get(line, at), at)
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None))
            continue
        kept = [x for pos, x in enumerate(t.split("\n")) if not x.strip(" ") or len(sites[x]) < least or first[x] == (i is not None, i or 0, pos)]
        out.append((i, "\n".join(kept)))
    return sorted(out, key=str)


def test_lines_equal_plain_python(spark):
    rng = random.Random(4)
    pool = [f"line {k}" for k in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))), f"s{i % 14}") for i in range(150)]
    rows += [(1000, None, "s1"), (1001, "", None), (1002, "line 1\n\nline 2", None), (1003, "alone", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for least in (4, 10, 13):
        out = lines.drop_boilerplate(docs, min_sites=least)
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == plain_lines(rows, least)


def test_lines_odd_rows(spark):
    docs = odd_docs(spark).withColumnRenamed("score", "n_removed")
    out = lines.drop_boilerplate(docs, min_sites=3)
    assert out.count() == 9 and set(out.columns) == {*docs.columns, "n_lines"}
    by = [(r["doc_id"], r["text"], r["n_removed"]) for r in out.collect()]
    assert (2, None, 0) in by and (7, "", 1) in by  # four sites (none is one of them) hold the line; the null id comes first
    assert lines.drop_boilerplate(none(spark)).count() == 0


# 8: language model


def brute_scores(rows, train, order, m):
    tokens = {i: (t or "").encode().lower().split() + [1] for i, t in rows}
    c, h = Counter(), Counter()
    for i, words in tokens.items():
        if train(i):
            padded = [0] * (order - 1) + words
            for j in range(order - 1, len(padded)):
                for n in range(order):
                    c[tuple(padded[j - n : j + 1])] += 1
                    h[tuple(padded[j - n : j])] += n > 0
    total, distinct = sum(v for k, v in c.items() if len(k) == 1), sum(len(k) == 1 for k in c)
    out = {}
    for i, words in tokens.items():
        padded, score, base = [0] * (order - 1) + words, 0.0, 0.0
        for j in range(order - 1, len(padded)):
            q = (c[(padded[j],)] + 1) / (total + distinct + 1)
            base += math.log10(q)
            for n in range(1, order):
                q = (c[tuple(padded[j - n : j + 1])] + m * q) / (h[tuple(padded[j - n : j])] + m)
            score += math.log10(q)
        out[i] = (len(words), sum(c[(w,)] > 0 for w in words), total, base, score)
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_language_model_equals_brute_force(spark, order):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randint(0, 30)) + (f" Rare{i}" if i % 3 == 0 else "")) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = language_model.score(docs, F.col("doc_id") % 5 != 2, order=order, weight=3.0, block_bytes=300).collect()
    want = brute_scores(rows, lambda i: i % 5 != 2, order, 3.0)
    assert len(got) == 62
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3]
        assert math.isclose(r["base_score"], w[3], abs_tol=1e-9) and math.isclose(r["score"], w[4], abs_tol=1e-9)


def test_language_model_query_has_order_three(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.randint(0, 30))) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_scores(rows, lambda i: zlib.crc32(str(i).encode()) % 7 != 2, 3, language_model.WEIGHT)
    for r in language_model.op8_language_model(spark, str(tmp_path)).collect():
        assert math.isclose(r["score"], want[r["doc_id"]][4], abs_tol=1e-9)


def test_language_model_asks_only_buckets_that_hold_ngrams():
    """Rows in the exchange are bounded by the n-grams of a block, however many buckets there are."""
    keys = np.sort(language_model.Block(["a b c", "b c d"], 3).keys(3))
    held, cuts = language_model._buckets(keys, 1 << 20)
    assert len(held) <= len(keys) and cuts[0] == 0 and cuts[-1] == len(keys) and all(np.diff(cuts) > 0)
    assert len(language_model._buckets(keys, 1)[0]) == 1


def test_language_model_odd_rows(spark):
    rows = language_model.score(odd_docs(spark), F.col("doc_id") == 1).collect()
    assert len(rows) == 9 and {r["train_tokens"] for r in rows} == {12}  # the repeated row counts twice
    assert {(r["n_tokens"], r["n_known"]) for r in rows if r["doc_id"] in (2, 3, 5)} == {(1, 1)}
    untrained = language_model.score(odd_docs(spark), F.lit(False)).collect()
    assert {(r["train_tokens"], r["n_known"]) for r in untrained} == {(0, 0)} and {r["base_score"] for r in untrained} == {0.0}
    assert language_model.score(none(spark), F.lit(True)).count() == 0


# 9: near-duplicates


def reach(ids, fps, limit=3):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= limit:
                x, y = root(ids[a]), root(ids[b])
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("group_rows", [2, 7, 4096])
def test_links_equal_brute_force(spark, group_rows):
    rng = random.Random(7)
    fps = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            fps.add(at)
            for _ in range(rng.randint(1, 4)):
                at ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s, s) for s in signed], "id long, fp long")
    linked = simhash.components(simhash._linked(nodes, group_rows=group_rows)).collect()
    want = reach(signed, fps)
    assert {r["id"]: r["component"] for r in linked} == {i: c for i, c in want.items() if list(want.values()).count(c) > 1}


def test_pivots_lose_nothing():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(k)) for k in range(0, 60, 7)]))
    got = {(min(int(a), int(b)), max(int(a), int(b))) for i, j in simhash.links(fps, simhash._pivots(), block=64) for a, b in zip(i, j)}
    want = {(a, b) for b in range(len(fps)) for a in range(b) if int(fps[a] ^ fps[b]).bit_count() <= 3}
    assert got == want


def test_fingerprint_by_definition():
    import xxhash

    def plain(text):
        words = text.encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rng = random.Random(9)
    for n in (0, 1, 2, 3, 4, 50, 300):
        text = prose(rng, n).replace("e o", "E \t\nÉo")
        assert simhash.fingerprint(text) == plain(text)


def test_one_of_each_keeps_every_text(spark):
    """Rows that share an id: whatever their order, each component keeps one row and no unique text goes."""
    a, b, c = (" ".join(f"{p}{k}" for k in range(40)) for p in "xyz")
    rows = [(1, a, "p"), (1, b, "q"), (2, a, "r"), (2, c, "s"), (3, b, "t"), (3, b, "u"), (1, a, "o"), (None, a, "n")]
    results = set()
    for order in (rows, rows[::-1], sorted(rows, key=str)):
        docs = spark.createDataFrame(order, "doc_id long, text string, _r1 string").repartition(3)
        results.add(tuple(sorted(map(str, simhash.one_of_each(docs).collect()))))
    assert len(results) == 1
    kept = spark.createDataFrame(rows, "doc_id long, text string, _r1 string")
    kept = [(r["doc_id"], r["text"]) for r in simhash.one_of_each(kept).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (2, c), (None, a)], key=str)


def test_quarters_leave_one_equal():
    for mask in (*simhash._masks(), (1 << 58) - 1, (1 << 60) - 1):
        while mask.bit_count() <= 60:
            parts = [q & ~mask for q in simhash._quarters(mask)]
            assert len(parts) == 4 and all(parts) and sum(p.bit_count() for p in parts) == 64 - mask.bit_count()
            mask = simhash._quarters(mask)[0]


def test_near_duplicates_odd_rows(spark):
    rows = simhash.near_duplicates(odd_docs(spark)).collect()
    got = sorted(((r["doc_id"], r["component_id"]) for r in rows), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 2), (3, 2), (None, 1), (4, 4), (5, 2), (6, 6), (7, 1)], key=str)
    assert all(r["fingerprint"] == "0" * 16 for r in rows if r["doc_id"] in (2, 3, 5))
    assert simhash.near_duplicates(none(spark)).count() == 0
    kept = simhash.one_of_each(odd_docs(spark))
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == ["1", "2", "4", "6", "None"]


# 10: benchmark


def test_tiling():
    item = "a b c d e f g h i j".split()
    assert tiling.tile(item, "f g h i j q a b c d e".split()) == 10  # parts in another order
    assert tiling.tile(item, "a b x c d y e f".split()) == 0
    assert tiling.tile("a a a a a a".split(), "a a a a".split()) == 4
    assert tiling.tile(item, item + item) == 10
    rng = random.Random(10)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        b = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
        got = tiling.tile(a, b, 2)
        longest = max((k for k in range(min(len(a), len(b)) + 1) if any(a[i : i + k] == b[j : j + k] for i in range(len(a) - k + 1) for j in range(len(b) - k + 1))))
        assert got <= min(len(a), len(b)) and (got >= longest if longest >= 2 else got == 0)


def greedy(a, b, least):
    """Marks the longest common run of unmarked tokens, the first in ``a`` and then in ``b``, until all are too short."""
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        runs = []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                runs.append((-k, i, j))
        k, i, j = min(runs, default=(0, 0, 0))
        if -k < max(least, 1):
            return covered
        free_a[i : i - k] = free_b[j : j - k] = [False] * -k
        covered -= k


def test_tiling_equals_greedy():
    rng = random.Random(13)
    for n in range(600):
        letters = "abcd"[: rng.randint(2, 4)] if n % 3 else "abcdefgh"
        a = [rng.choice(letters) for _ in range(rng.randint(0, 45))]
        b = [rng.choice(letters) for _ in range(rng.randint(0, 60))]
        if n % 2:
            cut = rng.randint(0, len(a))
            b[5:5] = a[cut:] + a[:cut]
        for least in (1, 2, 3, 5):
            assert tiling.tile(a, b, least) == greedy(a, b, least), (a, b, least)


@pytest.mark.parametrize("worker_bytes", [1 << 20, 0])
def test_contaminated_both_ways(spark, worker_bytes):
    rng = random.Random(11)
    passage = [f"w{k}" for k in range(20)]
    moved = passage[10:] + ["and"] + passage[:10]
    rows = [(1, prose(rng, 30) + " " + " ".join(passage) + " " + prose(rng, 30)), (2, " ".join(moved)), (3, " ".join(passage[:12])), (4, prose(rng, 200)), (5, None), (6, ""), (2, " ".join(moved)), (None, " ".join(passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(passage).upper()), (8, None), (9, ""), (10, "...")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["n_tokens"]) for r in tiling.contaminated(docs, bench, worker_bytes=worker_bytes).collect()), key=str)
    assert got == sorted([(1, 7, 20), (2, 7, 20), (2, 7, 20), (None, 7, 20)], key=str)
    clean = tiling.clean(docs, bench, worker_bytes=worker_bytes)
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == ["3", "4", "5", "6"]
    assert tiling.contaminated(docs.limit(0), bench).count() == 0 and tiling.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("worker_bytes", [1 << 20, 0])
def test_contaminated_short_items_and_marks(spark, worker_bytes):
    """Items of one to four tokens, combining marks, and an id that two items share, whichever way the benchmark goes."""
    marked = "re\u0301sume\u0301 na\u0131\u0308ve cafe\u0301 हिन्दी भाषा"
    items = [(1, "quartz"), (2, "Quartz vein"), (3, "vein of quartz"), (4, "a vein of quartz"), (5, marked), (6, "e\u0301"), (7, "basalt"), (7, "gneiss"), (None, "schist")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = ["see a vein of quartz here", "quartz, vein", "of a vein", f"x {marked} y", "the basalt or gneiss", "schist", "quart z", "resume naive cafe"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(
        ((i, n, len(tiling.tokens(item)), tiling.coverage(tiling.tokens(item), tiling.tokens(t))) for i, t in enumerate(texts) for n, item in items if tiling.coverage(tiling.tokens(item), tiling.tokens(t)) >= 0.8),
        key=str,
    )
    assert {(0, 1), (0, 3), (0, 4), (1, 1), (1, 2), (3, 5), (4, 7), (5, None)} <= {r[:2] for r in want}
    got = sorted((tuple(r) for r in tiling.contaminated(docs, bench, worker_bytes=worker_bytes).collect()), key=str)
    assert got == want
    clean = {r["doc_id"] for r in tiling.clean(docs, bench, worker_bytes=worker_bytes).collect()}
    assert clean == set(range(len(texts))) - {r[0] for r in want}


@pytest.mark.parametrize("worker_bytes", [1 << 20, 0])
def test_contaminated_equals_tiling_every_pair(spark, worker_bytes):
    """Passages whose blocks of three to six tokens stand in another order, or with every k-th word replaced."""
    rng = random.Random(12)
    names = [f"w{k}" for k in range(60)] + WORDS
    items = [(i, [rng.choice(names) for _ in range(rng.randint(1, 30))]) for i in range(60)]
    items += [(60, [f"v{k}" for k in range(20)]), (61, "a a a a b a a a a c".split())]
    docs = []
    for i, item in items:
        for size in (3, 4, 5, 6):
            blocks = [item[j : j + size] for j in range(0, len(item), size)]
            rng.shuffle(blocks)
            docs.append(sum(blocks, []))
            docs.append([f"x{i}" if j % size == size - 1 else w for j, w in enumerate(item)])
    docs.append(sum((items[60][1][j : j + 4] for j in (16, 8, 0, 12, 4)), []))
    docs.append([w if j % 5 < 4 else "other" for j, w in enumerate(items[60][1])])
    want = sorted((d, i, len(item), share) for d, doc in enumerate(docs) for i, item in items if (share := tiling.coverage(item, doc)) >= 0.8)
    assert {(len(docs) - 2, 60, 20, 1.0), (len(docs) - 1, 60, 20, 0.8)} <= set(want)
    doc_rows = spark.createDataFrame([(d, " ".join(doc)) for d, doc in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in items], "item_id long, text string")
    got = sorted(tuple(r) for r in tiling.contaminated(doc_rows, bench, worker_bytes=worker_bytes).collect())
    assert got == want
    clean = {r["doc_id"] for r in tiling.clean(doc_rows, bench, worker_bytes=worker_bytes).collect()}
    assert clean == set(range(len(docs))) - {r[0] for r in want}


def test_contaminated_odd_rows(spark):
    bench = spark.createDataFrame([(1, "the river and the stone"), (2, "the river")], "item_id long, text string")
    got = sorted(str(r["doc_id"]) for r in tiling.contaminated(odd_docs(spark), bench).filter("item_id = 1").collect())
    assert got == ["1", "1", "7", "None"]
    assert tiling.clean(odd_docs(spark), bench).columns == odd_docs(spark).columns


def test_common_seeds_bring_no_pairs(spark):
    """Documents and items that all share a phrase meet only where they share something rare."""
    docs = spark.createDataFrame([(k, f"one of the d{k} e{k} f{k} g{k} h{k} one of the") for k in range(300)], "k long, text string")
    item = lambda k: f"one of the a{k} b{k} c{k} d{k} e{k} f{k} g{k}"
    items = spark.createDataFrame([(k, item(k)) for k in range(300)], "b long, text string")
    pairs = tiling._candidates(docs, items, 0.8, 3)
    assert pairs.count() <= 600
    held = docs.unionByName(spark.createDataFrame([(1000, "so " + item(7)), (1001, "one of the a8 b8 c8 d8 e8 f8 x g8")], docs.schema))
    bench = items.withColumnRenamed("b", "item_id")
    for worker_bytes in (0, 1 << 20):
        got = {(r["doc_id"], r["item_id"]) for r in tiling.contaminated(held.withColumnRenamed("k", "doc_id"), bench, worker_bytes=worker_bytes).collect()}
        assert got == {(1000, 7), (1001, 8)}


# 2, 4: clashing columns and bad cells


def test_language_of_documents_with_clashing_columns(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 20) if i % 2 else prose(rng, 20)[::-1], "en" if i % 2 else "ne", 0.5, i, "k") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, share double, n long, kind string")
    model = language.learn(docs, F.col("doc_id") % 3 != 0)
    got = language.identify(docs, model).filter("lang_pred <> lang").count()
    assert got == 0 and language.recognised(docs, model).columns == docs.columns and language.recognised(docs, model).count() == 60


def test_mutated_media_are_errors_or_values(spark):
    """2,000 files with changed bytes: every cell gives a value or an error, in little memory."""
    import tracemalloc

    rng = random.Random(6)
    whole = media.frames(bytes(range(192)) * 40)
    at = whole.index(b"moov")
    tracemalloc.start()
    kinds = set()
    for _ in range(2000):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(at, len(data))] = rng.choice([0, 1, 255, rng.randrange(256)])
        data = bytes(data[: rng.choice([len(data)] * 4 + [rng.randrange(len(data))])])
        track, error = media.track_of(data)
        kinds.add(track is None)
        if track is not None:
            assert all(0 <= a and a + n <= len(data) for a, n in track.key_ranges()) and len(track.sample_bytes(data)) <= len(data)
            media.feature(track)
        else:
            assert error
    assert kinds == {True, False} and tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_bad_tables_of_media(spark):
    whole = media.frames(bytes(range(192)) * 40)
    put = lambda kind, skip, value: (lambda at: whole[:at] + value + whole[at + len(value) :])(whole.index(kind) + 4 + skip)
    nested = b""
    for _ in range(3000):
        nested = media._box(b"moov", nested)
    cells = {
        "none": None,
        "good": whole,
        "late key": put(b"stss", 8, b"\0\0\1\0"),
        "key 0": put(b"stss", 8, bytes(4)),
        "many samples": put(b"stsz", 8, b"\xff" * 4),
        "far chunk": put(b"stco", 8, b"\x7f" * 4),
        "nested": nested,
        "runs": put(b"stsc", 8, b"\0\0\0\x09"),
        "few": put(b"stsc", 12, bytes(4)),
    }
    frame = spark.createDataFrame([(i, 1, m) for i, m in enumerate(cells.values())], "doc_id long, n_bytes long, media binary")
    found = {r["doc_id"]: r for r in media.describe(frame).collect()}
    bad = {name for i, name in enumerate(cells) if found[i]["error"]}
    assert bad == set(cells) - {"none", "good"}
    assert {r["doc_id"] for r in media.digests(frame).filter("error IS NULL AND payload_sha256 IS NOT NULL").collect()} == {1}
