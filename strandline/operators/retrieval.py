"""Ranked evidence search: plan a query, credit lines, score by rarity and recency, collapse and page.

Planning runs on the driver over at most 64 terms. ``search`` works on records that no projection holds
and scans their lines: a line is a candidate if one of its index tokens contains a needle, so no index
has to be shuffled. ``store.Store.search`` takes candidates from stored postings instead; both rank by
``rank``. Two small aggregates come back to the driver: the vocabulary's cut (where more than 1,024 terms
match) and, per term, the number of records that are credited with it.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.text import MAX_QUERY_TERMS, MAX_VOCABULARY, MIN_NEEDLE, confidence, first_bytes, index_tokens, index_tokens_of, matched_positions, query_terms, recency, singular_variants

# Version of the scorer in cursors, prefix of cursors, lanes searched by default, limits.
SCORER, CURSOR = "aj-scorer.v3", "aj1."
DEFAULT_LANES = ("conversation", "delegated_work", "imported_legacy")
PER_EPISODE, MAX_RESULTS, DEFAULT_RESULTS, LINE_BYTES, SNIPPET_BYTES = 2, 100, 10, 400, 4096


@dataclass
class Plan:
    """Terms by position and the needles by which lines are found."""

    base: list[str]
    terms: list[str]
    alias_terms: list[str] = field(default_factory=list)
    folded_terms: list[str] = field(default_factory=list)
    needles: list[str] = field(default_factory=list)
    truncated: bool = False


def plan(query: str, aliases: dict[str, list[str]] | None = None) -> Plan:
    """The query's own terms with repeats, then alias values, then singular forms, each not yet there."""
    base, cut = query_terms(query)
    terms, have = list(base), set(base)
    added: dict[str, list[str]] = {"alias": [], "fold": []}
    for kind, more in (("alias", lambda t: (aliases or {}).get(t, [])), ("fold", singular_variants)):
        for t in base:
            for v in more(t):
                if v not in have:
                    have.add(v)
                    added[kind].append(v)
                    terms.append(v)
    cut = cut or len(terms) > MAX_QUERY_TERMS
    terms = terms[:MAX_QUERY_TERMS]
    parts = list(dict.fromkeys(n for t in terms for n in index_tokens_of(t)))
    long = [n for n in parts if len(n) >= MIN_NEEDLE]
    return Plan(base, terms, added["alias"], added["fold"], long or parts, cut)


@dataclass(frozen=True)
class Knobs:
    context_window: int = 3
    recency_boost: float = 1.0
    min_score: float = 0.0
    confidence_floor: float = 3.0
    mode: str = "word_start"


def has_needle(term: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(term, F.lit(n))
    return hit


def eligible(records: DataFrame, world: str, scope: str | None = None, lanes=DEFAULT_LANES) -> DataFrame:
    keep = (F.col("world") == world) & F.col("lane").isin(list(lanes))
    return records.filter(keep if scope is None else keep & (F.col("scope") == scope))


def vocabulary(lines: DataFrame, needles: list[str]) -> list[str]:
    """The first matching terms of a world in order; one more than the cap says that there are others."""
    some = lines.filter(has_needle(F.lower("line"), needles))  # other lines have no such term
    terms = some.select(F.explode(index_tokens(F.col("line"))).alias("term")).filter(has_needle(F.col("term"), needles))
    return [r[0] for r in terms.distinct().orderBy("term").limit(MAX_VOCABULARY + 1).collect()]


def credit(lines: DataFrame, p: Plan, mode: str = "word_start", cut: str | None = None) -> DataFrame:
    """Candidate lines with the positions of the terms that they are credited with."""
    found = F.exists(index_tokens(F.col("line")), lambda t: has_needle(t, p.needles) & (F.lit(True) if cut is None else t <= cut))
    cheap = has_needle(F.lower("line"), p.needles)  # holds for every candidate, and spares the others the tokenizer
    out = lines.filter(cheap & found).withColumn("mask", matched_positions(F.col("line"), p.terms, mode))
    return out.filter(F.size("mask") > 0)


def document_frequency(credited: DataFrame) -> DataFrame:
    """Per term position: records with a credited line; at position -1, records with any."""
    return credited.select("episode_id", F.explode(F.array_append("mask", F.lit(-1))).alias("position")).distinct().groupBy("position").agg(F.count("*").alias("df"))


def idf_weights(df_rows, n: int, size: int) -> list[float]:
    """ln(N / df) by position, 0 where nothing is credited."""
    df = {r["position"]: r["df"] for r in df_rows}
    return [math.log(max(n, 1) / df[i]) if df.get(i) else 0.0 for i in range(size)]


def scored(credited: DataFrame, idf: list[float], now_ms: int, boost: float = 1.0, digits: int | None = None) -> DataFrame:
    """Weights added in the order of positions, so that sums don't depend on how rows are dealt."""
    weights = F.array(*[F.lit(float(w)) for w in idf])
    rarity = F.aggregate("mask", F.lit(0.0), lambda a, i: a + F.element_at(weights, i + 1))
    score = rarity * recency(F.col("event_time_ms"), now_ms, boost)
    return credited.withColumn("score", score if digits is None else F.round(score, digits))


def ranked(hits: DataFrame, knobs: Knobs = Knobs(), per_episode: int = PER_EPISODE) -> DataFrame:
    """Best line of each span of a record, at most ``per_episode`` of a record, scores below the floor left out."""
    if knobs.min_score > 0:
        hits = hits.filter(F.col("score") >= knobs.min_score)
    order = [F.desc("score"), "rel_path", "line_no"]
    span = F.floor(F.col("line_no") / max(2 * knobs.context_window, 1))
    best = hits.withColumn("span", span).withColumn("in_span", F.row_number().over(Window.partitionBy("episode_id", "span").orderBy(*order))).filter("in_span = 1")
    if per_episode:
        best = best.withColumn("in_episode", F.row_number().over(Window.partitionBy("episode_id").orderBy(*order))).filter(F.col("in_episode") <= per_episode).drop("in_episode")
    return best.drop("span", "in_span")


def page(hits: DataFrame, p: Plan, limit: int = DEFAULT_RESULTS, offset: int = 0, floor: float = 3.0) -> DataFrame:
    """One page in order, with rank, matched terms, coverage and confidence."""
    limit = max(min(limit or DEFAULT_RESULTS, MAX_RESULTS), 1)
    order = [F.desc("score"), "rel_path", "line_no"]
    top = hits.orderBy(*order).limit(offset + limit)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter(F.col("rank") > offset)  # of a page's rows alone
    terms = F.array(*map(F.lit, p.terms))
    coverage = F.size("mask") / F.lit(len(p.terms))
    return (
        top.withColumn("matched_terms", F.array_distinct(F.transform("mask", lambda i: F.element_at(terms, i + 1))))
        .withColumn("coverage", coverage)
        .withColumn("confidence", confidence(F.col("score"), coverage, floor))
    )


@dataclass
class Found:
    """A search's ranked lines (all of them, lazily) and what the report says about it."""

    plan: Plan
    hits: DataFrame
    idf: list[float]
    n: int
    detail: str | None
    scored: DataFrame
    #: Candidates that were left out as their digest doesn't hold.
    edited: DataFrame | None = None


def search(records: DataFrame, lines: DataFrame, query: str, world: str, now_ms: int, scope: str | None = None, lanes=DEFAULT_LANES, aliases=None, knobs: Knobs = Knobs(), digits: int | None = None) -> Found | None:
    """Rank the world's lines for a query; None if the query has no term.

    Frequencies count the records that the filters leave; N counts the world's records outside the
    evaluation lane, and is never below the number of credited records.
    """
    p = plan(query, aliases)
    if not p.base:
        return None
    known = vocabulary(lines.filter(F.col("world") == world), p.needles)
    more = len(known) > MAX_VOCABULARY
    credited = credit(eligible(lines, world, scope, lanes), p, knobs.mode, known[MAX_VOCABULARY - 1] if more else None)
    n = records.filter((F.col("world") == world) & (F.col("lane") != "evaluation")).count()
    return rank(p, credited, n, now_ms, knobs, digits, more)


def rank(p: Plan, credited: DataFrame, n: int, now_ms: int, knobs: Knobs = Knobs(), digits: int | None = None, more: bool = False) -> Found:
    """The ranking of credited lines in a world of ``n`` records; ``more`` says that terms beyond the cap matched."""
    frequencies = document_frequency(credited).collect()  # a count for each of at most 64 terms
    n = max(n, 1, *(r["df"] for r in frequencies)) if frequencies else max(n, 1)
    idf = idf_weights(frequencies, n, len(p.terms))
    lines = scored(credited, idf, now_ms, knobs.recency_boost, digits)
    return Found(p, ranked(lines, knobs), idf, n, "discovery_truncated" if more or p.truncated else None, lines)


def with_snippets(rows: DataFrame, records: DataFrame, context: int = 3) -> DataFrame:
    """Add the lines around each row's line, each of at most 400 bytes; 4,096 bytes in all.

    Where lines up to the matched one overflow, the text begins again at the line that did not fit;
    after it, the text ends there. Only a page's rows should come here.
    """
    text = rows.join(records.select("episode_id", "content", "body_line"), "episode_id") if "content" not in rows.columns else rows
    first = F.greatest(F.col("body_line"), F.col("line_no") - context, F.lit(1))
    lines = F.split("content", "\n")
    some = F.slice(lines, first, F.greatest(F.least(F.col("line_no") + context, F.size(lines)) - first + 1, F.lit(0)))

    empty = F.struct(F.lit("").alias("text"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(False).alias("over"))

    def step(a: Column, x: Column) -> Column:
        no, piece = x["no"], x["line"]
        fits = F.octet_length(a["text"]) + F.octet_length(piece) + 1 <= SNIPPET_BYTES
        begun = a["start"] > 0
        fresh = F.struct(piece.alias("text"), no.alias("start"), no.alias("end"), F.lit(False).alias("over"))
        longer = F.struct(F.concat(a["text"], F.lit("\n"), piece).alias("text"), a["start"].alias("start"), no.alias("end"), F.lit(False).alias("over"))
        stop = F.struct(a["text"].alias("text"), a["start"].alias("start"), a["end"].alias("end"), F.lit(True).alias("over"))
        return F.when(a["over"], a).when(~fits & (no > F.col("line_no")), stop).when(~fits | ~begun, fresh).otherwise(longer)

    numbered = F.transform(some, lambda s, i: F.struct((i + first).cast("int").alias("no"), first_bytes(s, LINE_BYTES).alias("line")))
    made = F.aggregate(numbered, empty, step)
    out = text.withColumn("snippet_", made)
    return out.select(*[c for c in out.columns if c not in ("snippet_", "content", "body_line")], F.col("snippet_.text").alias("snippet"), F.col("snippet_.start").alias("snippet_start"), F.col("snippet_.end").alias("snippet_end"))


def span(lines: DataFrame, episode_id: str, first: int, last: int, max_lines: int = 400, max_bytes: int = 65536) -> DataFrame:
    """Body lines of one record between two numbers, up to a number of lines and of bytes."""
    some = lines.filter((F.col("episode_id") == episode_id) & F.col("line_no").between(first, min(last, first + max_lines - 1)))
    size = F.sum(F.octet_length("line") + 1).over(Window.partitionBy("episode_id").orderBy("line_no"))
    return some.withColumn("bytes", size).filter(F.col("bytes") <= max_bytes).select("episode_id", "line_no", "line")


def guard(query: str, world: str, scope: str, lanes, alias_digest: str) -> str:
    """Eight hex digits that bind a cursor to the query that made it."""
    h = hashlib.sha256(SCORER.encode())
    for f in (query, world, scope, ",".join(lanes), alias_digest):
        raw = f.encode()
        h.update(b"\0%d\0" % len(raw) + raw)
    return h.hexdigest()[:8]


def cursor(offset: int, guard_hex: str) -> str:
    return f"{CURSOR}{offset}.{guard_hex}"


def cursor_offset(text: str, guard_hex: str) -> int:
    """The offset of a cursor; ValueError unless it is spelled as made, for the same query."""
    number, dot, end = text.removeprefix(CURSOR).rpartition(".")
    if not text.startswith(CURSOR) or not dot or end != guard_hex or not number.isascii() or not number.isdigit() or str(int(number)) != number or int(number) >= 1 << 64:
        raise ValueError("malformed cursor")
    return int(number)
