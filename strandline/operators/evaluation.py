"""Many queries ranked in one job, and how well judged ones find what is relevant to them.

The rules are those of ``retrieval.search``; queries are a column of every step, so a judged set of any
length costs one scan of the vocabulary, one of the postings that match and one of their lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.text import MAX_VOCABULARY, credit_pattern, recency

from .retrieval import DEFAULT_LANES, PER_EPISODE, Knobs, plan

# Kinds of judged queries that count for the averages, and the kind that should find nothing.
SCORED, NEGATIVE = ("known_item", "plural_probe", "paraphrase"), "negative"
#: Characters of a needle by which it meets terms.
KEY = 3


def judged(spark: SparkSession, path: str) -> DataFrame:
    """A judged set of JSON lines as (id, type, query, relevant); lines of another shape, such as a heading, are left out."""
    schema = "id string, type string, query string, relevant array<string>"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).filter("id IS NOT NULL AND query IS NOT NULL")


def _with_needles(vocabulary: DataFrame, needles: DataFrame, lengths: list[int]) -> DataFrame:
    """(id, term) for terms that contain a needle of the query; they meet by the needle's first characters."""

    def parts(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("term") - k + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring("term", i, F.lit(k)))

    keyed = vocabulary.withColumn("key", F.explode(F.array_distinct(F.concat(*map(parts, lengths)))))
    return keyed.join(needles, "key").filter(F.contains("term", "needle")).select("id", "term").distinct()


def rank_many(queries: DataFrame, postings: DataFrame, lines: DataFrame, n: int, world: str, now_ms: int, top: int = 10, lanes=DEFAULT_LANES, knobs: Knobs = Knobs(), aliases=None, digits: int | None = None) -> DataFrame:
    """(id, rank, episode_id, rel_path, line_no, score, matched) of the ``top`` lines for each of (id, query).

    ``postings`` and ``lines`` are those of ``projection`` or of a store, lines with their records'
    metadata; ``n`` counts the world's records. Queries are planned on the driver: a judged set is made by
    hand. Queries without a term find nothing.
    """
    spark = queries.sparkSession
    plans = {r["id"]: plan(r["query"], aliases) for r in queries.select("id", "query").collect()}
    terms = [(i, at, t, credit_pattern(t, knobs.mode)) for i, p in plans.items() if p.base for at, t in enumerate(p.terms)]
    needles = [(i, needle, needle[:KEY]) for i, p in plans.items() if p.base for needle in p.needles]
    terms = spark.createDataFrame(terms, "id string, position int, term string, pattern string")
    lengths = sorted({len(key) for *_, key in needles}) or [KEY]
    needles = spark.createDataFrame(needles, "id string, needle string, key string")

    here = F.col("world") == world
    vocabulary = postings.filter(here).select("term").distinct()
    first = F.row_number().over(Window.partitionBy("id").orderBy("term"))
    known = _with_needles(vocabulary, needles, lengths).withColumn("at", first).filter(F.col("at") <= MAX_VOCABULARY).drop("at")
    pairs = postings.filter(here & F.col("lane").isin(list(lanes))).join(known, "term").select("id", "episode_id", "line_no").distinct()
    found = lines.filter(here & F.col("lane").isin(list(lanes))).join(pairs, ["episode_id", "line_no"])
    credits = found.join(terms, "id").filter(F.rlike("line", "pattern"))

    frequency = credits.groupBy("id", "position").agg(F.count_distinct("episode_id").alias("df"))
    size = credits.groupBy("id").agg(F.greatest(F.count_distinct("episode_id"), F.lit(max(n, 1))).alias("n"))
    weights = frequency.join(size, "id").select("id", "position", F.log(F.col("n") / F.col("df")).alias("weight"))
    added = F.aggregate(F.array_sort(F.collect_list(F.struct("position", "weight"))), F.lit(0.0), lambda a, x: a + x["weight"])
    of = ["id", "episode_id", "line_no", "rel_path", "event_time_ms"]
    scored = credits.join(weights, ["id", "position"]).groupBy(*of).agg(added.alias("rarity"), F.count("*").alias("matched"))
    score: Column = F.col("rarity") * recency(F.col("event_time_ms"), now_ms, knobs.recency_boost)
    scored = scored.withColumn("score", score if digits is None else F.round(score, digits)).filter(F.col("score") >= knobs.min_score)

    order = [F.desc("score"), "rel_path", "line_no"]
    span = F.floor(F.col("line_no") / max(2 * knobs.context_window, 1))
    best = scored.withColumn("span", span).withColumn("k", F.row_number().over(Window.partitionBy("id", "episode_id", "span").orderBy(*order))).filter("k = 1")
    best = best.withColumn("k", F.row_number().over(Window.partitionBy("id", "episode_id").orderBy(*order))).filter(F.col("k") <= PER_EPISODE)
    # The best of each episode first, so that a query's last sort holds one or two rows an episode.
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).filter(F.col("rank") <= top)
    return best.select("id", "rank", "episode_id", "rel_path", "line_no", "score", "matched")


def per_query(queries: DataFrame, hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """For each of (id, type): rank of the first relevant hit or null, distinct episodes and relevant hits among the first ten, best score.

    ``relevant`` has (id, episode_id), once for each.
    """
    marked = hits.filter("rank <= 10").join(relevant.withColumn("good", F.lit(True)), ["id", "episode_id"], "left")
    each = marked.groupBy("id").agg(
        F.min(F.when(F.col("good"), F.col("rank"))).alias("rank"),
        F.count_distinct("episode_id").alias("distinct_top10"),
        F.count_if(F.coalesce("good", F.lit(False))).alias("relevant_in_top10"),
        F.max("score").alias("best_score"),
    )
    return queries.select("id", "type").join(each, "id", "left").fillna({"distinct_top10": 0, "relevant_in_top10": 0, "best_score": 0.0})


def metrics(each: DataFrame) -> DataFrame:
    """One row: MRR at 10, recall at 1 and 10, mean distinct episodes, over judged queries; the best score of one that should find nothing."""
    kind, rank = F.col("type"), F.col("rank")
    scored = kind.isin(*SCORED)
    share = lambda hit: F.avg(F.when(scored, F.when(hit, 1.0).otherwise(0.0)))
    return each.agg(
        F.count_if(scored).alias("queries"),
        F.avg(F.when(scored, F.when(rank <= 10, 1 / rank).otherwise(0.0))).alias("mrr_at_10"),
        share(rank == 1).alias("recall_at_1"),
        share(rank <= 10).alias("recall_at_10"),
        F.avg(F.when(scored, F.col("distinct_top10"))).alias("mean_distinct_episodes_top10"),
        F.count_if(kind == NEGATIVE).alias("negatives"),
        F.max(F.when(kind == NEGATIVE, F.col("best_score"))).alias("best_negative_score"),
    )


def parity(one: DataFrame, two: DataFrame, digits: int = 9) -> DataFrame:
    """How two rankings (id, rank, episode_id, line_no, score) compare as ordered sequences, a row for each id that either has.

    ``moved_at`` is the first rank at which they differ, null where they don't, and ``why`` says how: score (the
    same line with another score), order (both lines are in both rankings), entered (the second ranking's line
    isn't in the first one), left (the other way round, or the second one ends here). Scores are compared at
    ``digits``. Queries that find nothing in either ranking have no row.
    """
    hit = lambda df, name: df.select("id", "rank", F.struct("episode_id", "line_no").alias(name), F.round("score", digits).alias(f"{name}_score"))
    listed = lambda df, name: df.groupBy("id").agg(F.collect_set(F.struct("episode_id", "line_no")).alias(name))  # noqa: E731  of a page each
    a, b = hit(one, "a"), hit(two, "b")
    both = a.join(b, ["id", "rank"], "full_outer")
    same = F.col("a").eqNullSafe(F.col("b")) & F.col("a_score").eqNullSafe(F.col("b_score"))
    first = both.groupBy("id").agg(F.min(F.when(~same, F.struct("rank", "a", "b"))).alias("m"), F.greatest(F.count("a"), F.count("b")).alias("hits"))
    known = first.join(listed(one, "in_a"), "id", "left").join(listed(two, "in_b"), "id", "left")
    x, y = F.col("m.a"), F.col("m.b")
    inside = lambda names, v: F.coalesce(F.array_contains(names, v), F.lit(False))
    why = F.when(F.col("m").isNotNull(), F.when(x.eqNullSafe(y), "score").when(y.isNull(), "left").when(~inside("in_a", y), "entered").when(x.isNotNull() & ~inside("in_b", x), "left").otherwise("order"))
    return known.select("id", "hits", F.col("m").isNull().alias("same"), F.col("m.rank").alias("moved_at"), why.alias("why"), x["episode_id"].alias("one_episode"), y["episode_id"].alias("two_episode"))
