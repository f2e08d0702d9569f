"""The registered queries and their DuckDB SQL, side by side."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import functions as F

from strandline.functions import contracts, identity, text
from strandline.operators import analytics, capture, evaluation, projection, prompts, redaction, repair, retrieval, store, transcripts, turns, verify
from strandline.sources import corpus
from strandline.sources.folders import local_path, shared_folder

from . import views
from .views import BEGIN_MS, GRAMS, HOUR_MS, LINES, LOGGED, NOW_MS, PAYLOADS, POSTS, REC, STATS, TURNS

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

QUERY, WORLD = "license version rights", "en"
ALIASES = {"license": ["apache", "mit"]}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Projection


def _posts(spark, d):
    return projection.postings(views.records(spark, d))


def _stats(spark, d):
    return projection.term_stats_of(views.records(spark, d))


@query(f"WITH {POSTS} SELECT * FROM posts")
def tokenize_index_postings(spark, d):
    return _posts(spark, d).select("world", "lane", "term", "episode_id", "line_no")


@query(f"WITH {STATS} SELECT * FROM stats")
def term_stats_df(spark, d):
    return _stats(spark, d)


@query(f"WITH {GRAMS} SELECT * FROM grams")
def vocab_trigrams(spark, d):
    return projection.term_trigrams(_stats(spark, d))


NEEDLES = ["licen", "right", "tion"]
_has = " OR ".join(f"contains(term, '{n}')" for n in NEEDLES)


@query(f"WITH {STATS} SELECT term FROM stats WHERE world = 'en' AND ({_has}) ORDER BY term LIMIT 1024")
def vocab_candidates_scan(spark, d):
    return projection.candidates_by_scan(_stats(spark, d), WORLD, NEEDLES)


@query(_SQL["vocab_candidates_scan"])
def vocab_candidates_trigram(spark, d):
    stats = _stats(spark, d)
    return projection.candidates_by_trigrams(stats, projection.term_trigrams(stats), WORLD, NEEDLES)


_others = "(SELECT DISTINCT world, term FROM posts WHERE episode_id NOT IN (SELECT lpad(doc_id::VARCHAR, 12, '0') FROM labels WHERE quality = 0))"


@query(f"WITH {POSTS} SELECT DISTINCT world, term FROM posts p WHERE NOT EXISTS (SELECT 1 FROM {_others} o WHERE o.world = p.world AND o.term = p.term)")
def new_vocabulary_anti_join(spark, d):
    """Terms that only documents of low quality bring."""
    low = views.table(spark, d, "labels").filter("quality = 0").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("episode_id"))
    posts = _posts(spark, d)
    return projection.new_vocabulary(projection.term_stats(posts), projection.term_stats(posts.join(low, "episode_id", "left_anti")))


@query(_SQL["new_vocabulary_anti_join"])
def dying_terms_semi_join(spark, d):
    """Terms that go when the documents of low quality go."""
    low = views.table(spark, d, "labels").filter("quality = 0").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("episode_id"))
    posts = _posts(spark, d)
    return projection.dying_terms(projection.term_stats(posts), posts.join(low, "episode_id", "left_semi"))


TERMS = ["license", "licensed", "rights", "version"]
_terms = ", ".join(f"'{t}'" for t in TERMS)


@query(f"WITH {POSTS} SELECT DISTINCT episode_id, line_no FROM posts WHERE term IN ({_terms})")
def posting_pairs(spark, d):
    return projection.posting_pairs(_posts(spark, d), TERMS)


@query(f"WITH {POSTS} SELECT p.episode_id, p.line_no, r.rel_path, r.scope, r.lane, r.event_time_ms FROM posts p JOIN rec r USING (episode_id) WHERE term = 'license' AND r.world = 'en' AND r.lane = 'conversation'")
def postings_for_term(spark, d):
    return projection.postings_for_term(_posts(spark, d), views.records(spark, d), "license", WORLD, None, ["conversation"])


@query(f"WITH {REC} SELECT world, scope, world = 'en' AND scope = 'src0' AS is_default FROM (SELECT DISTINCT world, scope FROM rec UNION SELECT 'en', 'src0')")
def catalog_pairs(spark, d):
    return projection.catalog(views.records(spark, d), WORLD, "src0")


def _copies(spark, d):
    """Every document twice, the second copy at a path that sorts earlier as text but later in the walk."""
    r = views.records(spark, d)
    return r.unionByName(r.withColumn("rel_path", F.concat(F.lit("en-copy/"), F.col("rel_path"))))


@query(f"WITH {REC} SELECT episode_id, CASE WHEN world < 'en-copy' THEN rel_path ELSE 'en-copy/' || rel_path END AS rel_path FROM rec")
def duplicate_ids_first_copy(spark, d):
    return projection.first_copies(_copies(spark, d).select("episode_id", "rel_path")).select("episode_id", "rel_path")


def _files(spark, d):
    return views.records(spark, d).select("rel_path", F.sha2(F.col("content").cast("binary"), 256).alias("file_hash"))


def _stored(spark, d):
    """What an earlier sync knew: no French text, German texts by another hash, and paths that are gone."""
    f = _files(spark, d).filter(~F.col("rel_path").startswith("fr/"))
    f = f.withColumn("file_hash", F.when(F.col("rel_path").startswith("de/"), F.sha2(F.col("file_hash").cast("binary"), 256)).otherwise(F.col("file_hash")))
    return f.withColumn("rel_path", F.when(F.col("rel_path").startswith("es/"), F.concat(F.lit("old/"), F.col("rel_path"))).otherwise(F.col("rel_path")))


_SYNC = f"""WITH {REC}, files AS (SELECT rel_path, sha256(content) AS now FROM rec),
stored AS (SELECT CASE WHEN rel_path LIKE 'es/%' THEN 'old/' || rel_path ELSE rel_path END AS rel_path,
                  CASE WHEN rel_path LIKE 'de/%' THEN sha256(now) ELSE now END AS then_ FROM files WHERE rel_path NOT LIKE 'fr/%'),
st AS (SELECT rel_path, CASE WHEN then_ IS NULL THEN 'new' WHEN now IS NULL THEN 'vanished' WHEN now = then_ THEN 'unchanged' ELSE 'edited' END AS status
       FROM files FULL JOIN stored USING (rel_path)),
rep AS (SELECT count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'edited') AS edited,
               count(*) FILTER (status = 'vanished') AS vanished, bool_and(status = 'unchanged') AS matches FROM st)
"""


@query(_SYNC + "SELECT * FROM st")
def change_status(spark, d):
    return projection.change_status(_files(spark, d), _stored(spark, d))


@query(_SYNC + "SELECT * FROM rep")
def sync_report(spark, d):
    return projection.sync_report(_files(spark, d), _stored(spark, d))


@query(_SYNC + "SELECT matches, unchanged + new + edited AS source, unchanged + edited + vanished AS indexed, CASE WHEN matches AND unchanged + edited + vanished = unchanged + new + edited THEN 'current' ELSE 'stale' END AS freshness FROM rep")
def freshness(spark, d):
    return projection.freshness(_files(spark, d), _stored(spark, d))


# Crediting and ranking


def _pattern(term: str, mode: str) -> str:
    before = "" if mode == "substring" else "(^|[^A-Za-z0-9_])"
    after = "([^A-Za-z0-9_]|$)" if mode == "whole_word" else ""
    return f"(?i){before}{re.escape(term)}{after}"


def _credits_sql(terms: list[str], needles: list[str], world: str = WORLD, lanes=retrieval.DEFAULT_LANES, scope: str | None = None, mode: str = "word_start") -> str:
    listed = ", ".join(f"({i}, '{t}', '{_pattern(t, mode)}')" for i, t in enumerate(terms))
    has = " OR ".join(f"contains(term, '{n}')" for n in needles)
    lane = ", ".join(f"'{x}'" for x in lanes)
    return f"""{POSTS}, vocab AS (SELECT DISTINCT term FROM posts WHERE world = '{world}' AND ({has}) ORDER BY term LIMIT 1024),
terms(position, term, pattern) AS (VALUES {listed}),
cand AS (SELECT DISTINCT episode_id, line_no FROM posts WHERE term IN (SELECT term FROM vocab)),
credits AS (
  SELECT l.*, t.position, t.term FROM lines l JOIN cand USING (episode_id, line_no) CROSS JOIN terms t
  WHERE l.world = '{world}' AND l.lane IN ({lane}){f" AND l.scope = '{scope}'" if scope else ""} AND regexp_matches(l.line, t.pattern))"""


def _scores_sql(p: retrieval.Plan, min_score: float = 0.0, window: int = 3, world: str = WORLD, **how) -> str:
    return _credits_sql(p.terms, p.needles, world, **how) + f""",
dfs AS (SELECT position, count(DISTINCT episode_id) AS df FROM credits GROUP BY position),
total AS (SELECT greatest((SELECT count(*) FROM rec WHERE world = '{world}' AND lane <> 'evaluation'), (SELECT count(DISTINCT episode_id) FROM credits), 1) AS n),
scored AS (
  SELECT episode_id, rel_path, scope, lane, line_no, line, count(*) AS matched, list(term ORDER BY position) AS found,
         round(sum(ln(n / df)) * any_value(CASE WHEN event_time_ms > {NOW_MS} THEN 1.0 ELSE 1 + 1.0 / (floor(({NOW_MS} - event_time_ms) / 86400000) + 1) END), 9) AS score
  FROM credits JOIN dfs USING (position), total GROUP BY ALL HAVING true),
spans AS (SELECT *, row_number() OVER (PARTITION BY episode_id, line_no // {max(2 * window, 1)} ORDER BY score DESC, rel_path, line_no) AS in_span FROM scored WHERE score >= {min_score}),
capped AS (SELECT * EXCLUDE (in_span) FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, rel_path, line_no) AS k FROM spans WHERE in_span = 1) WHERE k <= 2),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, rel_path, line_no)::INTEGER AS rank FROM capped)"""


_HIT = "rank, episode_id, rel_path, line_no, round(score, 6) AS score, matched, "
_BAND = "CASE WHEN score * matched / {k} >= 6 THEN 'high' WHEN score * matched / {k} >= 3 THEN 'medium' ELSE 'low' END AS confidence"


def _found(spark, d, q=QUERY, **how):
    r = views.records(spark, d)
    return retrieval.search(r, projection.body_lines(r), q, WORLD, NOW_MS, digits=9, **how)


def _hits(df):
    return df.select("rank", "episode_id", "rel_path", "line_no", F.round("score", 6).alias("score"), F.size("mask").cast("long").alias("matched"), "confidence")


def _page(spark, d, q=QUERY, limit=10, offset=0, **how):
    found = _found(spark, d, q, **how)
    return _hits(retrieval.page(found.hits, found.plan, limit, offset))


def _page_sql(q=QUERY, limit=10, offset=0, aliases=None, **how) -> str:
    p = retrieval.plan(q, aliases)
    return f"WITH {_scores_sql(p, **how)} SELECT {_HIT}{_BAND.format(k=len(p.terms))} FROM ranked WHERE rank > {offset} AND rank <= {offset + limit}"


def _credit_query(mode):
    p = retrieval.plan(QUERY)

    @query(f"WITH {_credits_sql(p.terms, p.needles, mode=mode)} SELECT episode_id, line_no, position FROM credits", f"credit_{mode}")
    def run(spark, d):
        lines = retrieval.eligible(projection.body_lines(views.records(spark, d)), WORLD)
        return retrieval.credit(lines, p, mode).select("episode_id", "line_no", F.explode("mask").alias("position"))


for _mode in ("substring", "word_start", "whole_word"):
    _credit_query(_mode)

_P = retrieval.plan(QUERY)


@query(f"WITH {_scores_sql(_P)} SELECT position, df, round(ln(n / df), 6) AS idf FROM dfs, total")
def query_df_idf(spark, d):
    found = _found(spark, d)
    df = retrieval.document_frequency(found.scored)
    return df.filter("position >= 0").select("position", "df", F.round(F.log(F.lit(float(found.n)) / F.col("df")), 6).alias("idf"))


@query(f"WITH {REC} SELECT CASE WHEN event_time_ms > {NOW_MS} THEN 1.0 ELSE round(1 + 1.0 / (floor(({NOW_MS} - event_time_ms) / 86400000) + 1), 9) END::DOUBLE AS recency, count(*) AS n FROM rec GROUP BY 1")
def recency_buckets(spark, d):
    r = views.records(spark, d).select(F.round(text.recency(F.col("event_time_ms"), NOW_MS), 9).alias("recency"))
    return r.groupBy("recency").agg(F.count("*").alias("n"))


def _rank_columns(df):
    return df.select("episode_id", "line_no", F.round("score", 6).alias("score"))


@query(f"WITH {_scores_sql(_P)} SELECT episode_id, line_no, round(score, 6) AS score FROM scored")
def rank_full(spark, d):
    return _rank_columns(_found(spark, d).scored)


@query(f"WITH {_scores_sql(_P)} SELECT episode_id, line_no, round(score, 6) AS score FROM spans WHERE in_span = 1")
def rank_span_dedupe(spark, d):
    return _rank_columns(retrieval.ranked(_found(spark, d).scored, per_episode=0))


@query(f"WITH {_scores_sql(_P)} SELECT episode_id, line_no, round(score, 6) AS score FROM ranked")
def rank_per_episode_cap(spark, d):
    return _rank_columns(_found(spark, d).hits)


@query(f"WITH {_scores_sql(_P, min_score=2.0)} SELECT episode_id, line_no, round(score, 6) AS score FROM ranked")
def rank_min_score(spark, d):
    return _rank_columns(_found(spark, d, knobs=retrieval.Knobs(min_score=2.0)).hits)


@query(_page_sql())
def search_page_1(spark, d):
    return _page(spark, d)


@query(_page_sql(offset=10))
def search_page_2(spark, d):
    return _page(spark, d, offset=10)


@query(_page_sql(limit=50, aliases=ALIASES))
def search_alias_expanded(spark, d):
    return _page(spark, d, limit=50, aliases=ALIASES)


@query(_page_sql("licenses versions", 50))
def search_plural_folded(spark, d):
    return _page(spark, d, "licenses versions", 50)


@query(_page_sql("license license rights", 50))
def search_duplicate_weight(spark, d):
    return _page(spark, d, "license license rights", 50)


@query(_page_sql(limit=50, scope="src16"))
def search_scope_filter(spark, d):
    return _page(spark, d, limit=50, scope="src16")


@query(_page_sql("tion ble ing", 50, lanes=("evaluation",)))
def search_eval_lane(spark, d):
    return _page(spark, d, "tion ble ing", 50, lanes=("evaluation",))


@query(_page_sql(limit=50, mode="whole_word"))
def search_whole_word(spark, d):
    return _page(spark, d, limit=50, knobs=retrieval.Knobs(mode="whole_word"))


@query(f"WITH {_scores_sql(_P)}, banded AS (SELECT {_BAND.format(k=len(_P.terms))} FROM ranked) SELECT confidence, count(*) AS n FROM banded GROUP BY confidence")
def confidence_bands(spark, d):
    found = _found(spark, d)
    coverage = F.size("mask") / F.lit(len(found.plan.terms))
    return found.hits.select(text.confidence(F.col("score"), coverage).alias("confidence")).groupBy("confidence").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_scores_sql(_P)}, top AS (SELECT * FROM ranked WHERE rank <= 10),
around AS (SELECT t.rank, t.episode_id, t.line_no, l.line_no AS no,
  decode(encode(l.line)[1:400]) AS line FROM top t JOIN lines l ON l.episode_id = t.episode_id AND l.line_no BETWEEN t.line_no - 3 AND t.line_no + 3)
SELECT rank, episode_id, line_no, string_agg(line, chr(10) ORDER BY no) AS snippet, min(no)::INTEGER AS snippet_start, max(no)::INTEGER AS snippet_end FROM around GROUP BY rank, episode_id, line_no"""
)
def snippets(spark, d):
    found = _found(spark, d)
    rows = retrieval.page(found.hits, found.plan, 10).select("rank", "episode_id", "line_no")
    return retrieval.with_snippets(rows, views.records(spark, d))


_ONE = "000000000029"


@query(f"WITH {LINES} SELECT episode_id, line_no, line FROM (SELECT *, sum(strlen(line) + 1) OVER (ORDER BY line_no) AS b FROM lines WHERE episode_id = '{_ONE}' AND line_no BETWEEN 1 AND 400) WHERE b <= 65536")
def get_span(spark, d):
    return retrieval.span(projection.body_lines(views.records(spark, d)), _ONE, 1, 400)


# The projection as it is stored


def _store(spark, *states):
    """A projection in a folder of its own, brought to each of some states of the corpus in turn."""
    found = store.Store(spark, f"{shared_folder(spark)}/projection-{uuid.uuid4().hex}")
    for state in states:
        found.sync(state)
    return found


def _parsed(spark, d):
    return views.records(spark, d).withColumn("parses", F.lit(True)).withColumn("verify_status", F.lit("ok"))


def _earlier(spark, d):
    """No French text yet, German ones before an edit, Spanish ones at another place."""
    r = _parsed(spark, d).filter("world <> 'fr'")
    r = r.withColumn("content", F.when(F.col("world") == "de", F.concat("content", F.lit(" formerly"))).otherwise(F.col("content")))
    return r.withColumn("rel_path", F.when(F.col("world") == "es", F.concat(F.lit("old/"), F.col("rel_path"))).otherwise(F.col("rel_path")))


def _without_low_quality(spark, d):
    low = views.table(spark, d, "labels").filter("quality = 0").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("episode_id"))
    return _parsed(spark, d).join(low, "episode_id", "left_anti")


_LOW = "(SELECT lpad(doc_id::VARCHAR, 12, '0') FROM labels WHERE quality = 0)"


@query(f"WITH {POSTS} SELECT * FROM posts")
def projection_upsert(spark, d):
    """Postings after a sync of an earlier state and one of the present state."""
    return _store(spark, _earlier(spark, d), _parsed(spark, d)).read("postings").select("world", "lane", "term", "episode_id", "line_no")


@query(f"WITH {POSTS} SELECT * FROM posts WHERE episode_id NOT IN {_LOW}")
def projection_delete(spark, d):
    """Postings once the documents of low quality are gone."""
    return _store(spark, _parsed(spark, d), _without_low_quality(spark, d)).read("postings").select("world", "lane", "term", "episode_id", "line_no")


@query(
    f"""WITH {POSTS} SELECT world, term, count(DISTINCT episode_id) FILTER (lane <> 'evaluation') AS df, count(DISTINCT episode_id) FILTER (lane = 'evaluation') AS eval_df
FROM posts WHERE episode_id NOT IN {_LOW} GROUP BY world, term"""
)
def projection_statistics(spark, d):
    """Document frequencies, added up over partitions, after the same."""
    return _store(spark, _parsed(spark, d), _without_low_quality(spark, d)).statistics()


@query(f"WITH {STATS} SELECT term FROM stats WHERE world = '{WORLD}'")
def projection_vocabulary(spark, d):
    return _store(spark, _parsed(spark, d)).vocabulary(WORLD)


@query(
    f"""WITH {REC}, cur AS (SELECT world, episode_id, episode_id LIKE '%7' AS bad FROM rec)
SELECT count(*) FILTER (NOT bad AND world <> 'en') AS indexed, count(*) FILTER (NOT bad AND world = 'en') AS unchanged, count(*) FILTER (bad AND world <> 'fr') AS removed,
 count(*) FILTER (bad) AS skipped_malformed, count(*) FILTER (world = 'en' AND episode_id LIKE '%0') AS duplicate_ids, count(*) FILTER (episode_id LIKE '%3') AS digest_mismatch, 2::BIGINT AS unreadable FROM cur"""
)
def sync_accounting(spark, d):
    """The seven counters of a sync: some files broke, some were edited in place, some lie there twice."""
    now = _parsed(spark, d).withColumn("parses", ~F.col("episode_id").endswith("7"))
    now = now.withColumn("verify_status", F.when(~F.col("parses"), "malformed").when(F.col("episode_id").endswith("3"), "digest_mismatch").otherwise("ok"))
    twice = now.filter((F.col("world") == "en") & F.col("episode_id").endswith("0")).withColumn("rel_path", F.concat(F.lit("zz/"), F.col("rel_path")))
    report = _store(spark, _earlier(spark, d)).sync(now.unionByName(twice), unreadable=2)
    return spark.createDataFrame([tuple(report.values())], ", ".join(f"{n} long" for n in report))


@query(_page_sql())
def search_via_postings(spark, d):
    found = _store(spark, _parsed(spark, d)).search(QUERY, WORLD, NOW_MS, digits=9)
    return _hits(retrieval.page(found.hits, found.plan, 10))


@query(_page_sql("tion ble ing", 50, lanes=("evaluation",)))
def search_via_postings_eval_lane(spark, d):
    """Needles that more terms than the cap hold."""
    found = _store(spark, _parsed(spark, d)).search("tion ble ing", WORLD, NOW_MS, lanes=("evaluation",), digits=9)
    return _hits(retrieval.page(found.hits, found.plan, 50))


_KNOWN = _page_sql().replace("AND regexp_matches(l.line, t.pattern)", f"AND l.episode_id NOT IN {_LOW} AND regexp_matches(l.line, t.pattern)")


@query(_KNOWN)
def search_verifies_sources(spark, d):
    """Documents of low quality were edited or went after the last sync: searches leave them out, and count the rest alone."""
    found = _store(spark, _parsed(spark, d))
    low = views.table(spark, d, "labels").filter("quality = 0").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("episode_id"), F.lit(True).alias("low")).distinct()
    now = _parsed(spark, d).join(low, "episode_id", "left").filter(~(F.coalesce("low", F.lit(False)) & F.col("episode_id").endswith("1")))
    now = now.withColumn("content", F.when(F.col("low"), F.concat("content", F.lit(" and more"))).otherwise(F.col("content")))
    hits = found.search(QUERY, WORLD, NOW_MS, digits=9, sources=store.hashes_of(now))
    return _hits(retrieval.page(hits.hits, hits.plan, 10))


@query(f"WITH {POSTS} SELECT DISTINCT world, term FROM posts WHERE episode_id NOT IN {_LOW}")
def projection_emptied_records(spark, d):
    """The vocabulary once the documents of low quality were edited so that no term is left in them."""
    low = views.table(spark, d, "labels").filter("quality = 0").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("episode_id"), F.lit(True).alias("low")).distinct()
    now = _parsed(spark, d).join(low, "episode_id", "left").withColumn("content", F.when(F.col("low"), "the").otherwise(F.col("content"))).drop("low")
    return _store(spark, _parsed(spark, d), now).statistics().select("world", "term")


@query(f"WITH {GRAMS} SELECT * FROM grams")
def projection_trigrams(spark, d):
    """The stored index of trigrams after a sync of an earlier state and one of the present state."""
    return _store(spark, _earlier(spark, d), _parsed(spark, d)).read("trigrams")


@query(_SQL["vocab_candidates_scan"])
def vocab_candidates_stored(spark, d):
    """Terms that hold a needle, from the parts of the stored index that have the needles' trigrams."""
    return _store(spark, _earlier(spark, d), _parsed(spark, d)).terms_with(WORLD, NEEDLES).orderBy("term").limit(1024)


@query(f"WITH {POSTS} SELECT * FROM posts")
def projection_compacted(spark, d):
    """Postings after three syncs and a compaction."""
    found = _store(spark, _earlier(spark, d), _without_low_quality(spark, d), _parsed(spark, d))
    found.compact()
    return found.read("postings").select("world", "lane", "term", "episode_id", "line_no")


def _parity_sql(*pages: str) -> str:
    return f"""WITH a AS (SELECT * FROM ({pages[0]})), b AS (SELECT * FROM ({pages[1]})),
both_ AS (SELECT coalesce(a.rank, b.rank) AS rank, a.episode_id AS ae, a.line_no AS al, a.score AS sa, b.episode_id AS be, b.line_no AS bl, b.score AS sb FROM a FULL JOIN b ON a.rank = b.rank),
moved AS (SELECT * FROM both_ WHERE (ae, al, sa) IS DISTINCT FROM (be, bl, sb) ORDER BY rank LIMIT 1)
SELECT (SELECT count(*) FROM both_) AS hits, m.rank IS NULL AS same, m.rank AS moved_at,
 CASE WHEN m.rank IS NULL THEN NULL WHEN ae IS NOT DISTINCT FROM be AND al IS NOT DISTINCT FROM bl THEN 'score' WHEN be IS NULL THEN 'left'
  WHEN NOT EXISTS (SELECT 1 FROM a WHERE a.episode_id = m.be AND a.line_no = m.bl) THEN 'entered'
  WHEN ae IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.episode_id = m.ae AND b.line_no = m.al) THEN 'left' ELSE 'order' END AS why,
 ae AS one_episode, be AS two_episode FROM (SELECT 1) LEFT JOIN moved m ON true"""


def _parity(spark, d, how):
    one, two = _page(spark, d, limit=50), _page(spark, d, limit=50, **how)
    return evaluation.parity(*[h.withColumn("id", F.lit("q")) for h in (one, two)], 6).drop("id")


@query(_parity_sql(_page_sql(limit=50), _page_sql(limit=50, mode="whole_word")))
def ranking_parity(spark, d):
    """The first place at which a ranking moves when whole words are asked for, and why."""
    return _parity(spark, d, {"knobs": retrieval.Knobs(mode="whole_word")})


@query(_parity_sql(_page_sql(limit=50), _page_sql(limit=50, window=8)))
def ranking_parity_window(spark, d):
    """The same for wider spans."""
    return _parity(spark, d, {"knobs": retrieval.Knobs(context_window=8)})


# Identity, contract, capture


@query(f"WITH {TURNS} SELECT conv_id, turn_no, user_content, assistant_result, first_message FROM turns")
def pair_turns(spark, d):
    return turns.pair_turns(views.table(spark, d, "conversations"))


@query(f"WITH {PAYLOADS} SELECT session_id, turn_id, episode_id FROM ident")
def episode_identity(spark, d):
    return views.payloads(spark, d).select("session_id", "turn_id", identity.episode_id().alias("episode_id"))


@query(f"WITH {PAYLOADS} SELECT session_id, turn_id, payload_digest FROM ident")
def payload_digest(spark, d):
    return views.payloads(spark, d).select("session_id", "turn_id", identity.payload_digest().alias("payload_digest"))


@query(f"WITH {PAYLOADS} SELECT session_id, turn_id, concat(strftime(make_timestamp(event_time_ms * 1000), '%Y/%m/%d'), '/', episode_id, '.md') AS rel_path FROM ident")
def layout_paths(spark, d):
    p = capture.prepared(views.payloads(spark, d))
    return p.select("session_id", "turn_id", "rel_path")


_ISO = "strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%SZ')"


@query(
    f"""WITH {PAYLOADS} SELECT session_id, turn_id, concat('---', chr(10), 'schema: aj-episode.v1', chr(10), 'episode_id: ', episode_id, chr(10), 'world: main', chr(10), 'scope: default', chr(10),
 'lane: conversation', chr(10), 'harness: chat', chr(10), 'adapter_version: 1.0', chr(10), 'session_id: ', session_id, chr(10), 'turn_id: ', turn_id, chr(10),
 'event_time: ', {_ISO.format('event_time_ms')}, chr(10), 'event_time_ms: ', event_time_ms, chr(10), 'capture_time: ', {_ISO.format('capture_time_ms')}, chr(10), 'capture_time_ms: ', capture_time_ms, chr(10),
 'capture_policy: every-turn', chr(10), 'turn_outcome: completed', chr(10), 'host: host-a', chr(10), 'payload_digest: sha256:', payload_digest, chr(10), '---', chr(10), chr(10),
 '## User', chr(10), chr(10), user_content, chr(10), chr(10), '## Assistant', chr(10), chr(10), assistant_result, chr(10), chr(10), '## Tools', chr(10), chr(10), '- search', chr(10), '- read', chr(10)) AS content FROM ident"""
)
def render_markdown(spark, d):
    return capture.prepared(views.payloads(spark, d)).select("session_id", "turn_id", identity.rendered().alias("content"))


def _stored_records(spark, d):
    """The rendered turns as files; those whose user part is longer than the reply were edited since."""
    p = capture.prepared(views.payloads(spark, d)).withColumn("content", identity.rendered())
    edited = F.regexp_replace("content", "\\n## Assistant\\n\\n", "\n## Assistant\n\nAdded later. ")
    longer = F.length("user_content") > F.length("assistant_result")
    return p.select("rel_path", F.when(longer, edited).otherwise(F.col("content")).alias("content"))


_STANDING = f"WITH {PAYLOADS}, s AS (SELECT concat(strftime(make_timestamp(event_time_ms * 1000), '%Y/%m/%d'), '/', episode_id, '.md') AS rel_path, length(user_content) > length(assistant_result) AS edited FROM ident) "


@query(_STANDING + "SELECT rel_path, CASE WHEN edited THEN 'digest_mismatch' ELSE 'ok' END AS verify_status FROM s")
def verify_status(spark, d):
    return verify.verified(_stored_records(spark, d)).select("rel_path", "verify_status")


@query(_STANDING + "SELECT rel_path, CASE WHEN edited THEN 'reseal' ELSE 'current' END AS action FROM s")
def reseal_preview(spark, d):
    return verify.reseal_preview(_stored_records(spark, d)).select("rel_path", "action")


# Transcripts, and the repair of records by them


@query(f"WITH {LOGGED} SELECT session_id, turn, turn_id, user_content, assistant_result, 'search,read' AS tools, event_time_ms FROM logged")
def transcript_turns(spark, d):
    """Conversations as logs with injected entries, command envelopes, tagged blocks and tool calls, read as turns."""
    found = transcripts.completed_turns(transcripts.entries(views.log_lines(spark, d)))
    return found.select(F.col("session").alias("session_id"), "turn", "turn_id", "user_content", "assistant_result", F.array_join("tools", ",").alias("tools"), "event_time_ms")


_REPLAYED = f"""{LOGGED}, old AS (
  SELECT concat(CASE role WHEN 'system' THEN 'lost-' ELSE 'conv-' END, conv_id) AS session_id, concat('u', turn) AS old_turn_id, {BEGIN_MS} + conv_id * {HOUR_MS} + turn * 1000 AS old_time_ms,
         CASE role WHEN 'user' THEN no END AS turn FROM entered WHERE role <> 'assistant'
), replayed AS (
  SELECT o.*, l.turn_id, l.event_time_ms, CASE WHEN starts_with(session_id, 'lost') THEN 'no_transcript' WHEN l.turn_id IS NULL THEN 'not_publishable' ELSE 'replace' END AS action
  FROM old o LEFT JOIN logged l USING (session_id, turn)
)"""


@query(f"WITH {_REPLAYED} SELECT session_id, old_turn_id, action, turn_id, turn_id <> old_turn_id AS reanchored FROM replayed")
def repair_report(spark, d):
    """What a repair would do with records of an earlier policy, some of which are anchored on what no one typed."""
    records = repair.outdated(views.old_files(spark, d))
    report = repair.replayed(records, transcripts.entries(views.log_lines(spark, d)), views.OLD_POLICY)
    return report.select("session_id", "old_turn_id", "action", "turn_id", "reanchored")


_path = lambda turn, time, policy: f"concat(strftime(make_timestamp({time} * 1000), '%Y/%m/%d'), '/aj1-', substr(sha256(concat('episode-id.v1', chr(0), 'chat', chr(0), session_id, chr(0), {turn}, chr(0), 'main', chr(0), '{policy}')), 1, 32), '.md')"


@query(
    f"""WITH {_REPLAYED} SELECT DISTINCT {_path('turn_id', 'event_time_ms', 'every-turn')} AS rel_path, session_id, turn_id, 'every-turn' AS capture_policy, 'ok' AS verify_status FROM replayed WHERE action = 'replace'
UNION ALL SELECT {_path('old_turn_id', 'old_time_ms', views.OLD_POLICY)}, session_id, old_turn_id, '{views.OLD_POLICY}', 'ok' FROM replayed WHERE action <> 'replace'"""
)
def repair_applied(spark, d):
    """The corpus after that repair: published into a folder, repaired there and read back."""
    folder = f"{local_path(shared_folder(spark))}/repair-{uuid.uuid4().hex}"
    root = f"{folder}/corpus"
    corpus.write(views.old_files(spark, d), root)
    held = lambda: corpus.read(spark, root).filter("kind = 'episode'").select("rel_path", F.col("content").cast("string").alias("content"))
    repair.Repair(spark, root, f"file://{folder}/ledger").run(held(), transcripts.entries(views.log_lines(spark, d)), views.OLD_POLICY, "every-turn", "1.0", NOW_MS)
    return verify.verified(held()).select("rel_path", "session_id", "turn_id", "capture_policy", "verify_status")


@query()
def redacted_messages(spark, d):
    """Conversations as JSON lines without their content; hashing words by line has no SQL."""
    c = views.table(spark, d, "conversations")
    return redaction.redact(c.select("conv_id", "turn", F.to_json(F.struct("role", "text", F.col("conv_id").cast("string").alias("id"))).alias("value")))


def _doubtful(spark, d):
    """Pages as payloads: hosts as worlds, urls as paths, texts as they are, so that several checks fail."""
    p = views.table(spark, d, "pages")
    null = F.lit(None).cast("string")
    return p.select(
        "page_id",
        F.lit(1).cast("long").alias("schema_version"),
        F.regexp_extract("url", "^https?://([^/]*)", 1).alias("world"),
        F.regexp_extract("url", "^https?://[^/]*/([^/]*)/", 1).alias("scope"),
        F.when(F.col("url").startswith("https"), "conversation").otherwise("talk").alias("lane"),
        F.lit("web").alias("harness"),
        F.lit("1.0").alias("adapter_version"),
        F.regexp_replace("url", "^https?:/", "").alias("session_id"),
        F.lit("t").alias("turn_id"),
        F.lit(views.BEGIN_MS).alias("event_time_ms"),
        F.lit("every-turn").alias("capture_policy"),
        F.lit("completed").alias("turn_outcome"),
        F.lit("q").alias("user_content"),
        F.col("html").alias("assistant_result"),
        F.array().cast("array<string>").alias("tools"),
        null.alias("workspace_root"),
        null.alias("branch_of"),
        null.alias("host"),
    )


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]*)', 1) AS world, regexp_extract(url, '^https?://[^/]*/([^/]*)/', 1) AS scope,
  url LIKE 'https%' AS known, regexp_replace(url, '^https?:/', '') AS session_id, html FROM pages),
w AS (SELECT *, replace(replace(world, '.', '-'), ':', '-') AS clean FROM p)
SELECT page_id, CASE WHEN NOT regexp_full_match(clean, '[a-z0-9-]{1,64}') THEN 'InvalidWorld'
 WHEN NOT regexp_full_match(scope, '[A-Za-z0-9._:+/@-]{1,128}') OR contains(scope, '/') OR starts_with(scope, '.') THEN 'InvalidScope'
 WHEN NOT known THEN 'InvalidLane' WHEN NOT regexp_full_match(session_id, '[A-Za-z0-9._:+/@-]{1,128}') THEN 'InvalidSessionID'
 WHEN html IS NULL OR html = '' THEN 'EmptyAssistantResult' WHEN strlen(html) > 2097152 THEN 'OversizedContent' END AS error FROM w"""
)
def validate_payloads(spark, d):
    p = _doubtful(spark, d).withColumn("world", F.regexp_replace("world", "[.:]", "-"))
    return p.select("page_id", contracts.error_name().alias("error"))


_FOLD = """WITH RECURSIVE e AS (
  SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS v, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events
), s AS (
  SELECT event_id, user_id, event_type, rn, v AS stored, CASE WHEN v IS NULL OR v = '' THEN 'malformed' ELSE 'published' END AS outcome FROM e WHERE rn = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.event_type, e.rn,
    CASE WHEN length(e.v) > length(s.stored) AND starts_with(e.v, s.stored) THEN e.v ELSE s.stored END,
    CASE WHEN e.v = s.stored THEN 'duplicate' WHEN length(e.v) > length(s.stored) AND starts_with(e.v, s.stored) THEN 'superseded' ELSE 'conflict' END
  FROM s JOIN e ON e.user_id = s.user_id AND e.event_type = s.event_type AND e.rn = s.rn + 1
) """


@query(_FOLD + "SELECT event_id AS seq, outcome FROM s")
def capture_outcomes(spark, d):
    return capture.outcomes(capture.prepared(views.deliveries(spark, d))).select("seq", "outcome")


@query(_FOLD + "SELECT outcome, count(*) AS n FROM s GROUP BY outcome")
def capture_outcome_counts(spark, d):
    return capture.outcomes(capture.prepared(views.deliveries(spark, d))).groupBy("outcome").agg(F.count("*").alias("n"))


@query(_FOLD + "SELECT concat('user-', user_id) AS session_id, event_type AS turn_id, arg_max(stored, rn) AS assistant_result FROM s GROUP BY user_id, event_type")
def capture_stored_turns(spark, d):
    p = capture.prepared(views.deliveries(spark, d))
    return capture.stored(p, capture.outcomes(p)).select("session_id", "turn_id", "assistant_result")


# Reports

_S = r"regexp_replace(line, '^\s+|\s+$', '', 'g')"
_CLASS = rf"""CASE WHEN length(s) = 0 THEN 'blank'
 WHEN regexp_matches(s, '^[A-Za-z_][A-Za-z0-9_]*\(\{{') OR regexp_matches(s, '^(\$ |> \$ |\+ |(read|write|edit|bash) /)') THEN 'tool'
 WHEN regexp_matches(s, '\S{{48,}}') THEN 'blob'
 WHEN coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(length(s), 1) < 0.5 OR len(w) < 3
 THEN CASE WHEN regexp_matches(s, '[{{}}\[\]<>|\\]|::|—>|sha256:|0x[0-9a-f]{{6,}}') THEN 'blob' ELSE 'other' END ELSE 'prose' END"""
_KINDS = f"{LINES}, cut AS (SELECT *, {_S} AS s, regexp_extract_all({_S}, '[A-Za-z]{{2,}}') AS w FROM lines), kinds AS (SELECT *, {_CLASS} AS kind FROM cut)"


@query(f"WITH {_KINDS} SELECT world, kind, count(*) AS n FROM kinds GROUP BY world, kind")
def line_classes(spark, d):
    lines = projection.body_lines(views.records(spark, d))
    return analytics.classified(lines).groupBy("world", "kind").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_KINDS}, c AS (SELECT scope AS session_id, count(*) AS content_lines, count(DISTINCT line) AS distinct_lines, count(*) FILTER (kind = 'prose') AS prose,
 count(*) FILTER (kind = 'tool') AS tool, count(*) FILTER (kind = 'blob') AS blob, count(*) FILTER (kind = 'other') AS other FROM kinds WHERE kind <> 'blank' GROUP BY scope),
b AS (SELECT scope AS session_id, count(*) AS episodes, sum(strlen(content))::BIGINT AS bytes FROM rec GROUP BY scope)
SELECT session_id, episodes, bytes, content_lines, distinct_lines, prose, tool, blob, other,
 round((1 - prose / content_lines) * (2 - distinct_lines / content_lines) / 2, 9) AS junk, round((1 - prose / content_lines) * (2 - distinct_lines / content_lines) / 2 * bytes, 3) AS junk_bytes
FROM c JOIN b USING (session_id) WHERE bytes >= 4096"""
)
def session_junk(spark, d):
    r = views.records(spark, d)
    lines = projection.body_lines(r).withColumnRenamed("scope", "session_id")
    out = analytics.junk_by_session(lines, r.withColumnRenamed("scope", "session_id").withColumn("user_content", F.lit("")))
    return out.withColumn("junk", F.round("junk", 9)).withColumn("junk_bytes", F.round("junk_bytes", 3))


@query(
    """WITH m AS (SELECT translate(trim(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS query, unnest([role, 'conv']) AS term, conv_id, turn FROM conversations)
SELECT query, count(DISTINCT (conv_id, turn)) AS count, list_sort(list_distinct(list(term))) AS terms FROM m WHERE query <> '' GROUP BY query"""
)
def miss_aggregate(spark, d):
    """The conversations' messages as a log of weak queries."""
    log = views.table(spark, d, "conversations").select(F.col("text").alias("query"), F.array("role", F.lit("conv")).alias("terms"))
    return analytics.weak_queries(log)


#: Judged queries: id, type, query, and what a document of one scope must hold to be relevant.
JUDGED = (
    ("notice", "known_item", "thanedble attion", "The and attion to thanedble the", "src3"),
    ("short", "known_item", "therhean esndha", "And therhean is the is esndha", "src5"),
    ("plural", "plural_probe", "licenses versions", "icense", "src8"),
    ("loose", "paraphrase", "edouhe ofretihaou rights", "Erreth was ofretihaou", "src11"),
    ("nothing", "negative", "quagga zyzzyva", None, None),
    ("rare", "negative", "rights zyzzyva", None, None),
)


def _judged_sql(i, q) -> str:
    p = retrieval.plan(q)
    return f"SELECT '{i}' AS id, rank, episode_id, rel_path, line_no, score, matched FROM (WITH {_scores_sql(p)} SELECT * FROM ranked WHERE rank <= 10)"


_RANKED = "\nUNION ALL ".join(_judged_sql(i, q) for i, _, q, _, _ in JUDGED)
_RELEVANT = "\nUNION ALL ".join(f"SELECT '{i}' AS id, lpad(doc_id::VARCHAR, 12, '0') AS episode_id FROM documents WHERE source = '{scope}' AND contains(text, '{phrase}')" for i, _, _, phrase, scope in JUDGED if phrase)


def _rank_judged(spark, d):
    r = views.records(spark, d)
    queries = spark.createDataFrame([x[:3] for x in JUDGED], "id string, type string, query string")
    n = r.filter((F.col("world") == WORLD) & (F.col("lane") != "evaluation")).count()
    return queries, evaluation.rank_many(queries, projection.postings(r), projection.body_lines(r), n, WORLD, NOW_MS, digits=9)


@query(f"SELECT id, rank::INTEGER AS rank, episode_id, rel_path, line_no, round(score, 6) AS score, matched FROM ({_RANKED})")
def search_many(spark, d):
    """Judged queries ranked in one job."""
    return _rank_judged(spark, d)[1].withColumn("score", F.round("score", 6))


@query(
    f"""WITH hits AS ({_RANKED}), relevant AS ({_RELEVANT}), judged(id, type) AS (VALUES {', '.join(f"('{i}', '{t}')" for i, t, *_ in JUDGED)}),
each_ AS (SELECT j.id, j.type, min(h.rank) FILTER (r.id IS NOT NULL) AS rank, count(DISTINCT h.episode_id) AS distinct_top10, coalesce(max(h.score), 0) AS best
  FROM judged j LEFT JOIN hits h ON h.id = j.id LEFT JOIN relevant r ON r.id = h.id AND r.episode_id = h.episode_id GROUP BY j.id, j.type)
SELECT count(*) FILTER (type <> 'negative') AS queries, round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END) FILTER (type <> 'negative'), 9) AS mrr_at_10,
 avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END) FILTER (type <> 'negative') AS recall_at_1, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) FILTER (type <> 'negative') AS recall_at_10,
 avg(distinct_top10) FILTER (type <> 'negative') AS mean_distinct_episodes_top10, count(*) FILTER (type = 'negative') AS negatives, round(max(best) FILTER (type = 'negative'), 6) AS best_negative_score FROM each_"""
)
def retrieval_metrics(spark, d):
    """How well the judged queries find the documents that hold their phrase."""
    queries, hits = _rank_judged(spark, d)
    docs = views.records(spark, d).filter("lane = 'conversation'")
    relevant = [docs.filter((F.col("scope") == scope) & F.contains("content", F.lit(phrase))).select(F.lit(i).alias("id"), "episode_id") for i, _, _, phrase, scope in JUDGED if phrase]
    found = evaluation.metrics(evaluation.per_query(queries, hits, reduce(lambda a, b: a.unionByName(b), relevant)))
    return found.withColumn("mrr_at_10", F.round("mrr_at_10", 9)).withColumn("best_negative_score", F.round("best_negative_score", 6))


_EVENTS = "SELECT user_id, event_type, epoch_us(ts) // 1000 AS t, lag(event_type) OVER w AS kind_before, lag(epoch_us(ts) // 1000) OVER w AS t_before, props, lag(props) OVER w AS props_before FROM events WHERE event_type IN ('signup', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type DESC)"


@query(f"SELECT concat('user-', user_id) AS session_id, t_before AS event_time_ms, props_before AS user_content, props AS assistant_result FROM ({_EVENTS}) WHERE event_type = 'purchase' AND kind_before = 'signup' AND t - t_before <= 172800000")
def prompt_stop_pairs(spark, d):
    """Sign-ups as prompts and purchases as the replies that end them, at most two days later."""
    e = views.table(spark, d, "events").filter("event_type IN ('signup', 'purchase')")
    kind = F.when(F.col("event_type") == "signup", "prompt").otherwise("stop")
    session = F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("session_id")
    seen = e.select(session, F.lit("t").alias("turn_id"), kind.alias("kind"), F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("time_ms"), F.col("props").alias("text"))
    return prompts.paired(seen).drop("turn_id")


@query(
    """WITH o AS (SELECT user_id, epoch_us(ts) // 1000 AS t, nullif(event_type, 'error') AS payload FROM events),
c AS (SELECT *, CASE WHEN payload IS DISTINCT FROM lag(payload) OVER w THEN 1 ELSE 0 END AS changed, row_number() OVER w AS rn FROM o WINDOW w AS (PARTITION BY user_id ORDER BY t, payload)),
r AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY rn) AS run, min(t) OVER (PARTITION BY user_id) AS first FROM c),
s AS (SELECT *, min(t) OVER (PARTITION BY user_id, run) AS since FROM r)
SELECT concat('user-', user_id) AS session_id, min(t) AS seen_ms, arg_min(payload, t) AS payload FROM s WHERE payload IS NOT NULL AND t - since >= 3600000 AND t - first <= 864000000 GROUP BY user_id"""
)
def settled_turns(spark, d):
    """Each user's events as looks at a turn: the first type that stays for an hour, within ten days; errors are no answer."""
    e = views.table(spark, d, "events")
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")).alias("seen_ms")
    looks = e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("session_id"), F.lit("t").alias("turn_id"), ms, F.nullif("event_type", F.lit("error")).alias("payload"))
    return prompts.settled(looks, 3_600_000, 864_000_000).drop("turn_id")


@query(
    """WITH m AS (SELECT translate(trim(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS query, unnest([role, 'conv']) AS term, conv_id, turn FROM conversations)
SELECT query, count(DISTINCT (conv_id, turn)) AS count, list_sort(list_distinct(list(term))) AS terms FROM m WHERE query <> '' GROUP BY query ORDER BY count DESC, query LIMIT 20"""
)
def top_weak_queries(spark, d):
    """The 20 most frequent messages, as weak queries."""
    log = views.table(spark, d, "conversations").select(F.col("text").alias("query"), F.array("role", F.lit("conv")).alias("terms"))
    return analytics.top_weak_queries(log)


@query(_SQL["session_junk"] + " ORDER BY junk_bytes DESC, session_id LIMIT 5")
def top_session_junk(spark, d):
    return analytics.top_junk(session_junk(spark, d), limit=5)


@query("SELECT page_id, CASE WHEN strlen(html) <= 300 THEN html ELSE concat(left(html, (SELECT max(n) FROM range(0, 301) t(n) WHERE strlen(left(html, n::INTEGER)) <= 300)::INTEGER), chr(10), '[content truncated by capture policy]') END AS html FROM pages")
def truncated_content(spark, d):
    return views.table(spark, d, "pages").select("page_id", text.truncated(F.col("html"), 300).alias("html"))


@query("SELECT page_id, CASE WHEN regexp_full_match(h, '[A-Za-z0-9._:+/@-]{1,128}') THEN h END AS host FROM (SELECT page_id, trim(split_part(regexp_extract(url, '^https?://([^/]*)', 1), '.', 1)) AS h FROM pages)")
def host_labels(spark, d):
    return views.table(spark, d, "pages").select("page_id", text.host_label(F.regexp_extract("url", "^https?://([^/]*)", 1)).alias("host"))


@query(
    f"""WITH {TURNS} SELECT conv_id, turn_no, concat('turn-', substr(sha256(concat('conv-', conv_id, chr(0), turn_no, chr(0), user_content, chr(0), assistant_result)), 1, 32)) AS turn_id FROM turns"""
)
def stable_turn_ids(spark, d):
    found = turns.pair_turns(views.table(spark, d, "conversations"))
    session, none = F.concat(F.lit("conv-"), F.col("conv_id").cast("string")), F.lit(None).cast("string")
    return found.select("conv_id", "turn_no", identity.stable_turn_id(session, none, F.col("turn_no"), F.col("user_content"), F.col("assistant_result")).alias("turn_id"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS in_force FROM conversations")
def session_policy_as_of(spark, d):
    c = views.table(spark, d, "conversations").withColumn("policy", F.when(F.col("role") == "system", F.col("text")))
    return analytics.policy_at(c, "conv_id", "turn", "policy").select("conv_id", "turn", "in_force")


@query("SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'purchase') AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def latest_run_per_session(spark, d):
    e = views.table(spark, d, "events").withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value")))
    return analytics.latest_by_session(e, "user_id", "event_id", "value")
