"""Tokens, crediting, folding, classes, cursors."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import retrieval


def column(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", make(F.col("v"))).orderBy("i").collect()]


def test_stop_words():
    assert len(text.STOP_WORDS) == 153 and len(set(text.STOP_WORDS)) == 153


def test_index_tokens(spark):
    lines = ["The Quick_fox a1 b", "x" * 129 + " ok", "", None, "Kelvin K no", "é-abc_9 OF", "q8 the the tea tea"]
    got = column(spark, lines, text.index_tokens)
    assert got == [["quick_fox", "a1"], ["ok"], [], None, ["kelvin"], ["abc_9"], ["q8", "tea", "tea"]]
    assert all(text.index_tokens_of(v) == g for v, g in zip(lines, got) if v is not None)


def test_query_terms():
    assert text.query_terms("The fox, THE Fox! ab é-cat") == (["fox", "fox", "cat"], False)
    many = " ".join(f"word{i}" for i in range(70))
    found, cut = text.query_terms(many)
    assert len(found) == 64 and cut


@pytest.mark.parametrize(
    ("term", "forms"),
    [("quotas", ["quota"]), ("boxes", ["boxe", "box"]), ("policies", ["policy"]), ("glass", []), ("ties", ["tie"]), ("uses", []), ("gas", []), ("cat", [])],
)
def test_singular(term, forms):
    # "uses" would give "use", which is a stop word; a term in -es of four letters loses its last one
    assert text.singular_variants(term) == forms


def test_trigrams(spark):
    assert column(spark, ["ab", "abc", "aaaa", "abcd", ""], text.trigrams) == [[], ["abc"], ["aaa"], ["abc", "bcd"], []]


@pytest.mark.parametrize(
    ("mode", "want"),
    [("substring", [True, True, True, True, False]), ("word_start", [True, True, False, True, False]), ("whole_word", [True, False, False, True, False])],
)
def test_credit(spark, mode, want):
    lines = ["see Port now", "portal", "report", "a-PORT.", "pört"]
    assert column(spark, lines, lambda c: text.credited(c, "port", mode)) == want


def test_credit_of_odd_terms(spark):
    assert column(spark, ["use llama.cpp", "llamaXcpp", r"a \E b"], lambda c: text.credited(c, "llama.cpp")) == [True, False, False]
    assert column(spark, [r"a \E b"], lambda c: text.credited(c, r"\E")) == [True]
    with pytest.raises(ValueError):
        text.credited(F.lit("x"), "x", "anywhere")


def test_recency_and_confidence(spark):
    day = 86_400_000
    r = spark.range(1).select(text.recency(F.lit(10 * day), 10 * day).alias("a"), text.recency(F.lit(0), 3 * day + 5).alias("b"), text.recency(F.lit(9), 5).alias("c")).first()
    assert (r.a, r.b, r.c) == (2.0, 1.25, 1.0)
    bands = spark.createDataFrame([(6.0, 1.0), (6.0, 0.5), (2.9, 1.0), (12.0, 9.0)], "s double, c double").select(text.confidence(F.col("s"), F.col("c")))
    assert [x[0] for x in bands.collect()] == ["high", "medium", "low", "high"]


def test_line_class(spark):
    lines = ["  ", "Bash({", "$ ls", "x" * 48, "{ } <a>", "two words", "these are three words", "1 2 3 4 a"]
    assert column(spark, lines, text.line_class) == ["blank", "tool", "tool", "blob", "blob", "other", "prose", "other"]


def test_plan_keeps_repeats_and_adds_once():
    p = retrieval.plan("foxes foxes den", {"den": ["lair", "foxes"], "foxes": ["q8"]})
    assert p.terms == ["foxes", "foxes", "den", "q8", "lair", "foxe", "fox"]
    assert p.needles == ["foxes", "den", "lair", "foxe", "fox"]  # a two-letter needle counts only where there is no longer one
    assert retrieval.plan("q8x", {"q8x": ["q8"]}).needles == ["q8x"]


def test_cursor():
    g = retrieval.guard("q", "main", "", ["conversation"], "d")
    assert retrieval.cursor_offset(retrieval.cursor(20, g), g) == 20
    for bad in (f"aj1.020.{g}", f"aj1.20.{g[:-1]}x", f"20.{g}", "aj1.20", f"aj1.-1.{g}", f"aj1.{1 << 64}.{g}"):
        with pytest.raises(ValueError):
            retrieval.cursor_offset(bad, g)


def test_spans_equal_the_greedy_loop(spark):
    rng = random.Random(0)
    rows = [(f"e{rng.randint(0, 5)}", rng.randint(1, 60), float(rng.randint(0, 6))) for _ in range(400)]
    rows = sorted({(e, n): (e, n, s) for e, n, s in rows}.values())
    df = spark.createDataFrame([(e, e, n, s) for e, n, s in rows], "episode_id string, rel_path string, line_no int, score double")
    for window, floor in ((3, 0.0), (1, 2.0), (0, 0.0)):
        seen, per, want = set(), {}, []
        for e, n, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
            key = (e, n // max(2 * window, 1))
            if floor and s < floor or key in seen or per.get(e, 0) >= 2:
                continue
            seen.add(key)
            per[e] = per.get(e, 0) + 1
            want.append((e, n))
        got = retrieval.ranked(df, retrieval.Knobs(context_window=window, min_score=floor)).orderBy(F.desc("score"), "rel_path", "line_no")
        assert [(r.episode_id, r.line_no) for r in got.collect()] == want


def test_snippet_bounds(spark):
    long = "é" * 300
    content = "\n".join(["head", "body"] + [f"{i} " + "x" * 390 for i in range(30)] + [long, "", "end"])
    rows = spark.createDataFrame([("e", 3, content, 2), ("e", 33, content, 2), ("e", 35, content, 2)], "episode_id string, line_no int, content string, body_line int")

    def plain(line, window, body=2):
        out, start, end = [], 0, line
        for no, s in enumerate(content.split("\n"), 1):
            if no < max(body, line - window) or no > line + window:
                continue
            raw = s.encode()[:400]
            piece = raw.decode("utf-8", "ignore")
            if sum(len(x.encode()) + 1 for x in out) - bool(out) + len(piece.encode()) + 1 > 4096:
                if no > line:
                    break
                out, start = [], 0
            start = start or no
            out.append(piece)
            end = no
        return "\n".join(out), start, end

    for window in (3, 10):
        got = retrieval.with_snippets(rows, None, window).collect()
        assert sorted((r.snippet, r.snippet_start, r.snippet_end) for r in got) == sorted(plain(n, window) for n in (3, 33, 35))
    assert re.search("é$", plain(33, 0)[0])
