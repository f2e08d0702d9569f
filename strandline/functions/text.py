"""Tokens, crediting, folding and line classes as column expressions, with driver-side twins for queries."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that neither a query nor the index keeps.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can "
    "need dare ought used to of in for on with at by from as into through during before after above below between "
    "out off over under again further then once here there when where why how all both each few more most other "
    "some such no nor not only own same so than too very just because but and or if while about up down what which "
    "who whom this that these those i me my myself we our ours ourselves you your yours yourself yourselves he him "
    "his himself she her hers herself it its itself they them their theirs themselves also get got like know think "
    "want look use find give tell say said take come make go see thing things really something anything remember "
    "mentioned talked"
).split()
_STOP = frozenset(STOP_WORDS)

# Limits of the tokenizers and of discovery.
MAX_QUERY_TERMS, MAX_TOKEN, MIN_NEEDLE, MAX_VOCABULARY = 64, 128, 3, 1024

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other characters stay, unlike with ``lower``."""
    return F.translate(text, UPPER, LOWER)


def index_tokens(line: Column) -> Column:
    """Index terms of a line, in order and with repeats: runs of letters, digits and _ of 2 to 128 bytes.

    Runs are cut out before they are lowered, so that no other character turns into a letter.
    """
    runs = F.regexp_extract_all(line, F.lit("([A-Za-z0-9_]+)"), F.lit(1))
    return F.filter(F.transform(runs, F.lower), lambda t: F.length(t).between(2, MAX_TOKEN) & ~t.isin(STOP_WORDS))


def index_tokens_of(line: str) -> list[str]:
    runs = (r for r in re.findall("[A-Za-z0-9_]+", line) if 2 <= len(r) <= MAX_TOKEN)
    return [t for t in (r.lower() for r in runs) if t not in _STOP]


def query_terms(query: str) -> tuple[list[str], bool]:
    """Terms of a query in order, repeats kept, and whether terms beyond the cap were left out."""
    found = [t for t in re.findall("[a-z0-9_]+", query.translate(str.maketrans(UPPER, LOWER))) if len(t) > 2 and t not in _STOP]
    return found[:MAX_QUERY_TERMS], len(found) > MAX_QUERY_TERMS


def singular_variants(term: str) -> list[str]:
    """Singular forms that a plural term may have."""
    if term.endswith("ies") and len(term) > 4:
        forms = [term[:-3] + "y"]
    elif term.endswith("es") and len(term) > 4:
        forms = [term[:-1], term[:-2]]
    elif term.endswith("s") and not term.endswith("ss") and len(term) > 3:
        forms = [term[:-1]]
    else:
        forms = []
    return [f for f in forms if len(f) > 2 and f not in _STOP]


def trigrams(term: Column) -> Column:
    """Distinct three-byte parts of an index term; none if it is shorter (a sequence would count down)."""
    parts = F.transform(F.sequence(F.lit(1), F.length(term) - 2), lambda i: F.substring(term, i, F.lit(3)))
    return F.when(F.length(term) >= 3, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def _quoted(term: str) -> str:
    return "".join(c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c for c in term)


def credit_pattern(term: str, mode: str = "word_start") -> str:
    """What finds the term, in any case, under the mode's rule for its borders."""
    before = "" if mode == "substring" else "(?<![A-Za-z0-9_])"
    after = "(?![A-Za-z0-9_])" if mode == "whole_word" else ""
    if mode not in ("substring", "word_start", "whole_word"):
        raise ValueError(f"no such credit mode: {mode}")
    return f"(?i){before}{_quoted(term)}{after}"


def credited(line: Column, term: str, mode: str = "word_start") -> Column:
    return line.rlike(credit_pattern(term, mode))


def matched_positions(line: Column, terms: list[str], mode: str = "word_start") -> Column:
    """Positions (from 0) of the terms that the line is credited with, ascending."""
    each = [F.when(credited(line, t, mode), F.lit(i)) for i, t in enumerate(terms)]
    return F.array_compact(F.array(*each))


def recency(event_ms: Column, now_ms: int, boost: float = 1.0) -> Column:
    """1 + boost / (whole days passed + 1); 1 for the future."""
    days = F.floor((F.lit(now_ms) - event_ms) / F.lit(86_400_000))
    return F.when(event_ms > now_ms, F.lit(1.0)).otherwise(1.0 + F.lit(float(boost)) / (days + 1))


def confidence(score: Column, coverage: Column, floor: float = 3.0) -> Column:
    if floor <= 0:
        return F.lit("high")
    strength = score * F.greatest(F.least(coverage, F.lit(1.0)), F.lit(0.0))
    return F.when(strength >= 2 * floor, "high").when(strength >= floor, "medium").otherwise("low")


# What marks a line as a tool call, a shell line or a blob.
TOOL_LINE = r"\A[A-Za-z_][A-Za-z0-9_]*\(\{"
SHELL_LINE = r"\A(\$ |> \$ |\+ |(read|write|edit|bash) /)"
BLOB_LINE = r"[{}\[\]<>|\\]|::|—>|sha256:|0x[0-9a-f]{6,}"
LONG_RUN = r"\S{48,}"


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def line_words(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit("([A-Za-z]{2,})"), F.lit(1))


def line_class(line: Column) -> Column:
    """blank, tool, blob, other or prose."""
    return line_kind(stripped(line), line_words(stripped(line)))


def line_kind(s: Column, words: Column) -> Column:
    """The same for a line that is ``stripped`` already and its ``line_words``."""
    letters = F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w))
    return (
        F.when(F.length(s) == 0, "blank")
        .when(s.rlike(TOOL_LINE) | s.rlike(SHELL_LINE), "tool")
        .when(s.rlike(LONG_RUN), "blob")
        .when((letters / F.greatest(F.length(s), F.lit(1)) < 0.5) | (F.size(words) < 3), F.when(s.rlike(BLOB_LINE), "blob").otherwise("other"))
        .otherwise("prose")
    )


# Longest text that is taken in, in bytes, and what says that it was cut.
MAX_CONTENT, CUT_MARK = 1_500_000, "\n[content truncated by capture policy]"


def first_bytes(text: Column, most: int) -> Column:
    """As many whole characters as ``most`` bytes hold."""
    raw = text.cast("binary")
    # A character has four bytes at most, so one of four cuts leaves none open.
    whole = F.filter(F.array(*[F.lit(most - k) for k in range(4)]), lambda k: F.is_valid_utf8(F.substring(raw, F.lit(1), k)))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), F.element_at(whole, 1)).cast("string"))


def truncated(text: Column, most: int = MAX_CONTENT) -> Column:
    """A text of at most ``most`` bytes; of a longer one the beginning and a mark."""
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(first_bytes(text, most), F.lit(CUT_MARK)))


def host_label(name: Column) -> Column:
    """A host's name up to its first dot, or null if that is no token."""
    label = F.trim(F.substring_index(name, ".", 1))
    return F.when(label.rlike(r"\A[A-Za-z0-9._:+/@-]{1,128}\z"), label)
