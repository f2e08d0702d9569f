"""The pipeline on a small corpus, and the registry."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import registry


def corpus(spark, folder):
    rng = random.Random(12)
    words = "the river and stone house with light over water near green field an open letter market".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = " ".join(f"fact{k}" for k in range(15))
    rows = [(i, "\n".join(text(25) for _ in range(6)), "en", f"s{i % 12}") for i in range(80)]
    rows += [(100 + i, "Read our terms.\n" + text(60), "en", f"s{i}") for i in range(12)]
    rows += [(200, rows[3][1], "en", "s9"), (201, text(30) + " " + passage, "en", "s1"), (202, "12 34 !!", "en", "s2"), (203, None, "en", "s2"), (204, "你好", None, None)]
    docs = spark.createDataFrame([(i, t, g, s, len(t or "")) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_run(spark, tmp_path):
    folder = str(tmp_path)
    docs = corpus(spark, folder)
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert out == {*range(80), *range(100, 112)}
    step = corpus_pipeline.drop_lines(spark, docs, folder)
    assert step.columns == docs.columns and step.filter(F.col("text").contains("Read our terms.")).count() == 1
    assert [n for n, _ in corpus_pipeline.STAGES][2].startswith("SimHash") and len(corpus_pipeline.STAGES) == 5


def test_registry_names():
    names = list(registry.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert set(registry.oracle_sql()) <= set(names)


def test_empty_corpus(spark, tmp_path):
    folder = str(tmp_path)
    docs = corpus(spark, folder)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
