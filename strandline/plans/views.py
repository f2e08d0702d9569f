"""The driver's tables as records, payloads and deliveries, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import STOP_WORDS
from strandline.sources.folders import spread

BEGIN_MS, HOUR_MS, NOW_MS = 1_700_000_000_000, 3_600_000, 1_800_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents by language and source, and benchmark items as records of the evaluation lane."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    b = table(spark, sf_dir, "benchmark")

    def one(df, number, prefix, world, scope, lane):
        name = F.concat(F.lit(prefix), F.lpad(number.cast("string"), 12, "0"))
        return df.select(
            name.alias("episode_id"),
            F.concat_ws("/", world, scope, name).alias("rel_path"),
            world.alias("world"),
            scope.alias("scope"),
            F.lit(lane).alias("lane"),
            (BEGIN_MS + number * HOUR_MS).alias("event_time_ms"),
            F.col("text").alias("content"),
            F.lit(1).alias("body_line"),
        )

    return one(d, d["doc_id"], "", d["lang"], d["source"], "conversation").unionByName(one(b, b["item_id"], "b", F.lit("en"), F.lit("benchmark"), "evaluation"))


def _rec(table: str, number: str, prefix: str, world: str, scope: str, lane: str) -> str:
    name = f"concat('{prefix}', lpad({number}::VARCHAR, 12, '0'))"
    return (
        f"SELECT {name} AS episode_id, concat({world}, '/', {scope}, '/', {name}) AS rel_path, {world} AS world, {scope} AS scope, "
        f"'{lane}' AS lane, {BEGIN_MS} + {number} * {HOUR_MS} AS event_time_ms, text AS content FROM {table}"
    )


REC = f"rec AS ({_rec('documents', 'doc_id', '', 'lang', 'source', 'conversation')} UNION ALL {_rec('benchmark', 'item_id', 'b', chr(39) + 'en' + chr(39), chr(39) + 'benchmark' + chr(39), 'evaluation')})"
LINES = REC + """, lines AS (
  SELECT * EXCLUDE (content), unnest(string_split(content, chr(10))) AS line,
         generate_subscripts(string_split(content, chr(10)), 1)::INTEGER AS line_no FROM rec)"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
POSTS = LINES + f""", posts AS (
  SELECT DISTINCT world, lane, term, episode_id, line_no FROM (
    SELECT world, lane, episode_id, line_no, unnest(list_transform(regexp_extract_all(line, '[A-Za-z0-9_]+'), lambda t: lower(t))) AS term FROM lines)
  WHERE length(term) BETWEEN 2 AND 128 AND term NOT IN ({_STOP}))"""
STATS = POSTS + """, stats AS (
  SELECT world, term, count(DISTINCT episode_id) FILTER (lane <> 'evaluation') AS df,
         count(DISTINCT episode_id) FILTER (lane = 'evaluation') AS eval_df FROM posts GROUP BY world, term)"""
GRAMS = STATS + """, grams AS (
  SELECT DISTINCT world, substr(term, i::INTEGER, 3) AS trigram, term
  FROM (SELECT world, term, unnest(range(1, length(term) - 1)) AS i FROM stats WHERE length(term) >= 3))"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed turns of the conversations as payloads."""
    from strandline.operators.turns import pair_turns

    turns = pair_turns(table(spark, sf_dir, "conversations"))
    return turns.select(
        F.lit(1).cast("long").alias("schema_version"),
        F.lit("main").alias("world"),
        F.lit("default").alias("scope"),
        F.lit("conversation").alias("lane"),
        F.lit("chat").alias("harness"),
        F.lit("1.0").alias("adapter_version"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session_id"),
        F.concat(F.lit("turn-"), F.col("turn_no").cast("string")).alias("turn_id"),
        (BEGIN_MS + F.col("conv_id") * HOUR_MS + F.col("turn_no") * 1000).alias("event_time_ms"),
        F.lit("every-turn").alias("capture_policy"),
        F.lit("completed").alias("turn_outcome"),
        "user_content",
        "assistant_result",
        F.array(F.lit("search"), F.lit("read")).alias("tools"),
        F.lit(None).cast("string").alias("workspace_root"),
        F.lit(None).cast("string").alias("branch_of"),
        F.lit("host-a").alias("host"),
        (BEGIN_MS + F.col("conv_id") * HOUR_MS + 60_000).alias("capture_time_ms"),
    )


TURNS = """marked AS (
  SELECT *, sum(begins) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS turn_no FROM (
    SELECT *, CASE WHEN role = 'user' AND coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant', true) THEN 1 ELSE 0 END AS begins
    FROM conversations WHERE role IN ('user', 'assistant'))
), turns AS (
  SELECT * FROM (
    SELECT conv_id, turn_no, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (role = 'user' AND trim(text) <> ''), '') AS user_content,
           arg_max(text, turn) FILTER (role = 'assistant' AND trim(text) <> '') AS assistant_result, min(turn) AS first_message
    FROM marked GROUP BY conv_id, turn_no)
  WHERE user_content <> '' AND assistant_result IS NOT NULL
)"""
PAYLOADS = TURNS + f""", pay AS (
  SELECT concat('conv-', conv_id) AS session_id, concat('turn-', turn_no) AS turn_id, user_content, assistant_result,
         {BEGIN_MS} + conv_id * {HOUR_MS} + turn_no * 1000 AS event_time_ms, {BEGIN_MS} + conv_id * {HOUR_MS} + 60000 AS capture_time_ms FROM turns
), ident AS (
  SELECT *, concat('aj1-', substr(sha256(concat('episode-id.v1', chr(0), 'chat', chr(0), session_id, chr(0), turn_id, chr(0), 'main', chr(0), 'every-turn')), 1, 32)) AS episode_id,
    sha256(concat('digest.v1', FRAMES)) AS payload_digest FROM pay
)"""
_f = lambda v: f"chr(0), strlen({v}), chr(0), {v}"
PAYLOADS = PAYLOADS.replace("FRAMES", ", ".join(map(_f, ["'main'", "'default'", "'conversation'", "'chat'", "session_id", "turn_id", "event_time_ms::VARCHAR", "'every-turn'", "'completed'", "user_content", "assistant_result", "'2'", "'search'", "'read'"])))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as deliveries: each user's events of one type are one turn, delivered again and again.

    The text delivered is the property number, so that equal, extending and conflicting ones occur.
    """
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.lit(1).cast("long").alias("schema_version"),
        F.lit("main").alias("world"),
        F.lit("default").alias("scope"),
        F.lit("conversation").alias("lane"),
        F.lit("events").alias("harness"),
        F.lit("1.0").alias("adapter_version"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_type").alias("turn_id"),
        F.lit(BEGIN_MS).alias("event_time_ms"),
        F.lit("every-turn").alias("capture_policy"),
        F.lit("completed").alias("turn_outcome"),
        F.lit("state").alias("user_content"),
        F.get_json_object("props", "$.k").alias("assistant_result"),
        F.array().cast("array<string>").alias("tools"),
        F.lit(None).cast("string").alias("workspace_root"),
        F.lit(None).cast("string").alias("branch_of"),
        F.lit(None).cast("string").alias("host"),
    )


OLD_POLICY = "every-turn.v0"


def _time_ms():
    return BEGIN_MS + F.col("conv_id") * HOUR_MS + F.col("turn") * 1000


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lines of session logs.

    Of the user's messages one in four is injected by a program, one in eight a command's envelope, and the
    others end in a block that a program added.
    """
    text = F.col("text")
    block = lambda kind, **v: F.struct(F.lit(kind).alias("type"), *[c.alias(n) for n, c in v.items()])
    injected = F.col("turn") % 4 == 2
    typed = F.when(injected, text).when(F.col("turn") % 8 == 4, F.concat(F.lit("<command-name>/ask</command-name><command-args>"), text, F.lit("</command-args>")))
    typed = typed.otherwise(F.concat(text, F.lit("\n<system-reminder>seen</system-reminder>\n")))
    none = F.lit(None).cast("string")
    said = F.array(block("text", text=text, name=none), block("tool_use", text=none, name=F.lit("search")), block("tool_use", text=none, name=F.lit("read")))
    common = [F.concat(F.lit("u"), F.col("turn").cast("string")).alias("uuid"), F.date_format(F.timestamp_millis(_time_ms()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")]
    line = (
        F.when(F.col("role") == "user", F.to_json(F.struct(F.lit("user").alias("type"), injected.alias("isMeta"), *common, F.struct(typed.alias("content")).alias("message"))))
        .when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("assistant").alias("type"), *common, F.struct(F.lit("end_turn").alias("stop_reason"), said.alias("content")).alias("message"))))
        .otherwise(F.to_json(F.struct(F.lit("system").alias("type"), *common)))
    )
    session = F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session")
    return spread(table(spark, sf_dir, "conversations")).select(session, F.col("turn").alias("line_no"), line.alias("value"))


#: The same log's completed turns: what the owner typed, and all that was said until they typed again.
LOGGED = f"""entered AS (
  SELECT *, sum(CASE WHEN role = 'user' AND turn % 4 <> 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS no FROM conversations
), logged AS (
  SELECT * FROM (
    SELECT concat('conv-', conv_id) AS session_id, no AS turn, concat('u', min(turn)) AS turn_id, trim(arg_min(text, turn)) AS user_content,
           string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant' AND trim(text) <> '') AS assistant_result, {BEGIN_MS} + conv_id * {HOUR_MS} + min(turn) * 1000 AS event_time_ms
    FROM entered WHERE no > 0 GROUP BY conv_id, no)
  WHERE length(user_content) >= 3 AND assistant_result IS NOT NULL
)"""


def old_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of an earlier policy for each of the user's messages, typed or injected, and for each of the system's in a session without a log."""
    from strandline.functions.identity import rendered
    from strandline.operators.capture import prepared

    c = spread(table(spark, sf_dir, "conversations")).filter("role <> 'assistant'")
    lost = F.when(F.col("role") == "system", "lost-").otherwise("conv-")
    fixed = {"world": "main", "scope": "default", "lane": "conversation", "harness": "chat", "adapter_version": "0.9", "capture_policy": OLD_POLICY, "turn_outcome": "completed", "assistant_result": "As it was projected.", "host": "host-a"}
    p = c.select(
        F.lit(1).cast("long").alias("schema_version"), *[F.lit(v).alias(n) for n, v in fixed.items()], F.concat(lost, F.col("conv_id").cast("string")).alias("session_id"),
        F.concat(F.lit("u"), F.col("turn").cast("string")).alias("turn_id"), _time_ms().alias("event_time_ms"), _time_ms().alias("capture_time_ms"), F.col("text").alias("user_content"),
        F.array().cast("array<string>").alias("tools"), F.lit(None).cast("string").alias("workspace_root"), F.lit(None).cast("string").alias("branch_of"),
    )
    return prepared(p).select("rel_path", rendered().alias("content"))
