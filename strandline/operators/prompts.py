"""Prompts and the replies that end them, paired by session and turn, in batch and as a stream.

A prompt waits until a reply to its turn comes; a later prompt of the same turn takes its place, a reply
uses it up, and after two days it is forgotten. Prompts of fewer than three characters and empty replies
don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# Shortest prompt, and how long one waits.
LEAST, WAIT_MS = 3, 48 * 3_600_000
PAIR = "session_id string, turn_id string, event_time_ms long, user_content string, assistant_result string"


def counts(kind: Column, text: Column) -> Column:
    """Whether an event counts: a prompt long enough, or a reply that says something."""
    size = F.length(F.regexp_replace(text, r"\A\s+|\s+\z", ""))
    return F.coalesce(((kind == "prompt") & (size >= LEAST)) | ((kind == "stop") & (size > 0)), F.lit(False))


def paired(events: DataFrame, wait_ms: int = WAIT_MS) -> DataFrame:
    """Turns of (session_id, turn_id, kind, time_ms, text): a reply with the prompt right before it.

    Times are those of the prompts. Of events at the same time prompts come first.
    """
    by = Window.partitionBy("session_id", "turn_id").orderBy("time_ms", "kind", "text")
    seen = events.filter(counts(F.col("kind"), F.col("text"))).select(
        "*", *[F.lag(c).over(by).alias(f"{c}_before") for c in ("kind", "time_ms", "text")]
    )
    hit = (F.col("kind") == "stop") & (F.col("kind_before") == "prompt") & (F.col("time_ms") - F.col("time_ms_before") <= wait_ms)
    return seen.filter(hit).select("session_id", "turn_id", F.col("time_ms_before").alias("event_time_ms"), F.col("text_before").alias("user_content"), F.col("text").alias("assistant_result"))


class Waiting(StatefulProcessor):
    """Holds the prompt of a turn until its reply comes."""

    def __init__(self, wait_ms: int = WAIT_MS, forget: bool = True):
        self.wait_ms, self.forget = wait_ms, forget

    def init(self, handle) -> None:
        ttl = {"ttlDurationMs": self.wait_ms} if self.forget else {}
        self.prompt = handle.getValueState("prompt", "time_ms long, text string", **ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        events = sorted(e for pdf in rows for e in zip(pdf["time_ms"].tolist(), pdf["kind"], pdf["text"]))
        waiting = self.prompt.get() if self.prompt.exists() else None
        out = []
        for at, kind, text in events:
            if kind == "prompt":
                waiting = (at, text)
            elif waiting is not None:
                if at - waiting[0] <= self.wait_ms:
                    out.append((*key, waiting[0], waiting[1], text))
                waiting = None
        if waiting is not None:
            self.prompt.update(waiting)
        elif self.prompt.exists():
            self.prompt.clear()
        yield pd.DataFrame(out, columns=["session_id", "turn_id", "event_time_ms", "user_content", "assistant_result"])

    def close(self) -> None:
        pass


def paired_stream(events: DataFrame, wait_ms: int = WAIT_MS, forget: bool = True) -> DataFrame:
    """``paired`` over a stream. Needs the RocksDB state store.

    With ``forget``, prompts also go once they have waited too long by the clock; a stream of that kind
    never runs out of work, so leave it out where one is to end with its input.
    """
    seen = events.filter(counts(F.col("kind"), F.col("text"))).select("session_id", "turn_id", "kind", F.col("time_ms").cast("long"), "text")
    return seen.groupBy("session_id", "turn_id").transformWithStateInPandas(Waiting(wait_ms, forget), PAIR, "Append", "ProcessingTime" if forget else "None")


# How long a turn must look the same before it counts as whole, and how long one looks.
QUIET_MS, LOOK_MS = 150, 2000


def settled(observed: DataFrame, quiet_ms: int = QUIET_MS, look_ms: int = LOOK_MS) -> DataFrame:
    """(session_id, turn_id, seen_ms, payload) of turns that have come to rest, at the first look that shows it.

    ``observed`` has a row for each look: session_id, turn_id, seen_ms and what was there, null where the
    turn wasn't complete. A payload counts once it has stayed the same for ``quiet_ms``; looks that come
    later than ``look_ms`` after a turn's first one are too late.
    """
    turn = Window.partitionBy("session_id", "turn_id")
    by = turn.orderBy("seen_ms", "payload")
    changed = ~F.col("payload").eqNullSafe(F.lag("payload").over(by))
    runs = observed.withColumn("run", F.sum(changed.cast("long")).over(by)).withColumn("first", F.min("seen_ms").over(turn))
    since = F.min("seen_ms").over(Window.partitionBy("session_id", "turn_id", "run"))
    calm = runs.withColumn("since", since).filter(F.col("payload").isNotNull() & (F.col("seen_ms") - F.col("since") >= quiet_ms) & (F.col("seen_ms") - F.col("first") <= look_ms))
    first = calm.groupBy("session_id", "turn_id").agg(F.min(F.struct("seen_ms", "payload")).alias("hit"))
    return first.select("session_id", "turn_id", "hit.seen_ms", "hit.payload")


class Settling(StatefulProcessor):
    """Holds what a turn looked like last, since when, and when it was first looked at, until its window is over."""

    def __init__(self, quiet_ms: int = QUIET_MS, look_ms: int = LOOK_MS):
        self.quiet_ms, self.look_ms = quiet_ms, look_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("turn", "first_ms long, since_ms long, payload string, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        looks = sorted(((at, "" if p is None else p, p) for pdf in rows for at, p in zip(pdf["seen_ms"].tolist(), pdf["payload"])), key=lambda x: x[:2])
        held = self.state.get() if self.state.exists() else None
        if held is None:
            # Whatever comes of it, nothing of a turn is kept beyond its window.
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.look_ms)
        first, since, payload, done = held or (looks[0][0], looks[0][0], looks[0][2], False)
        out = []
        for at, _, p in looks:
            if p != payload:
                since, payload = at, p
            if not done and p is not None and at - since >= self.quiet_ms and at - first <= self.look_ms:
                done = True
                out.append((*key, at, p))
        self.state.update((first, since, payload, done))
        yield pd.DataFrame(out, columns=["session_id", "turn_id", "seen_ms", "payload"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=["session_id", "turn_id", "seen_ms", "payload"])

    def close(self) -> None:
        pass


def settled_stream(observed: DataFrame, quiet_ms: int = QUIET_MS, look_ms: int = LOOK_MS) -> DataFrame:
    """``settled`` over a stream of looks. Needs the RocksDB state store.

    Looks within a micro-batch may come in any order, micro-batches in that of their looks. A turn is given up,
    and its state goes, once ``look_ms`` have passed by the clock since it was first seen; looks that come
    after that begin a new window. A stream with such timers doesn't end by itself.
    """
    looks = observed.select("session_id", "turn_id", F.col("seen_ms").cast("long"), "payload")
    return looks.groupBy("session_id", "turn_id").transformWithStateInPandas(Settling(quiet_ms, look_ms), "session_id string, turn_id string, seen_ms long, payload string", "Append", "ProcessingTime")
