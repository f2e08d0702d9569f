"""Turns out of message logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair_turns(messages: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row per completed turn: its messages of the user, joined, and the assistant's last text.

    A turn begins where a user message follows an assistant's. Other roles are left out, and so are
    turns without one of the two sides.
    """
    own = messages.filter(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy(session).orderBy(order)
    begins = (F.col("role") == "user") & F.coalesce(F.lag("role").over(w) == "assistant", F.lit(True))
    marked = own.withColumn("turn_no", F.sum(begins.cast("int")).over(w).cast("long"))
    user, reply = F.col("role") == "user", (F.col("role") == "assistant") & (F.trim("text") != "")
    parts = F.array_sort(F.collect_list(F.when(user & (F.trim("text") != ""), F.struct(order, "text"))))
    turns = marked.groupBy(session, "turn_no").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("user_content"),
        F.max_by("text", F.when(reply, F.col(order))).alias("assistant_result"),
        F.min(order).alias("first_message"),
    )
    return turns.filter((F.col("user_content") != "") & F.col("assistant_result").isNotNull())
