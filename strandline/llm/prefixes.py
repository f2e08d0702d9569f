"""The prefix trie of conversations, by chained digests.

Every conversation's turns are read in order and each prefix gets the digest of the one before it and the
turn: equal digests are equal prefixes. All prefixes are exploded and grouped by depth and digest, which
gives the nodes. For sums over subtrees each node is exploded to its ancestors. Chains of nodes with the
same members are one link there (a part of such a chain is told by running sums along the conversation),
and a link reaches ``REACH`` ancestors at once and the others by way of the last of these, so neither
long conversations nor deep branching make rows in proportion to the square of their depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, table
from .dialogue import crc

#: Conversations that share the first turns of their first one; first turns shared are the hash modulo ``MOST``.
BLOCK, MOST = 100, 6
#: Ancestors that a link is exploded to at once.
REACH = 32
#: Ids in a piece of text that is hashed as a whole.
PIECE = 4096
PREFIX = "conv_id long, depth long, digest binary, parent binary, chars long, run long, ends boolean"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, of, turn, role, text, most): each conversation's own turns and, with ``of`` 0, the first ones that it takes over.

    ``most`` is how many first turns of ``of`` 0 count, and how many of ``of`` 1 don't. Texts are replaced by
    their digest and length.
    """
    own = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), *[F.coalesce(conversations[c].cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    own = own.filter(F.col("conv_id").isNotNull())
    # The role's length in front keeps role and text apart.
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    slim = own.select("conv_id", "turn", "role", F.substring("text", 1, 64).alias("begin"), said.alias("said"), F.length("text").cast("long").alias("chars"))
    most = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    # The limit by rank goes ahead of the shuffle, so a long conversation brings no more than a few turns of each task.
    place = Window.partitionBy("conv_id").orderBy("turn", "role", "begin", "said")
    first = slim.filter(F.col("conv_id") % BLOCK == 0).withColumn("place", F.row_number().over(place)).filter(F.col("place") < MOST)
    first = first.drop("place").withColumnRenamed("conv_id", "base")
    ids = slim.select("conv_id").distinct().select("conv_id", base.alias("base"), most.alias("most"))
    taken = ids.filter("most > 0 AND conv_id <> base").join(first, "base").select("conv_id", F.lit(0).alias("of"), "turn", "role", "begin", "said", "chars", "most")
    return slim.select("conv_id", F.lit(1).alias("of"), "turn", "role", "begin", "said", "chars", F.when(base != F.col("conv_id"), most).otherwise(0).alias("most")).unionByName(taken)


def prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation, the empty one included, with chained digests.

    Turns are sorted within partitions and read one by one: nothing of a conversation is held but the last digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, [0, 0]
        for batch in batches:
            out = []
            for conv, of, said, chars, most in zip(*(c.to_pylist() for c in batch.columns)):
                if last is None or last[0] != conv:
                    if last is not None:
                        out.append((*last, True))
                    last, seen = (conv, 0, hashlib.sha256(b"").digest(), None, 0, 0), [0, 0]
                seen[of] += 1
                if (seen[of] <= most) == (of == 0):
                    out.append((*last, False))
                    _, depth, digest, _, _, run_ = last
                    last = (conv, depth + 1, hashlib.sha256(digest + said).digest(), digest, chars, run_ + chars)
            yield _rows(out)
        yield _rows([] if last is None else [(*last, True)])

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "of", "turn", "role", "begin", "said")
    return dealt.select("conv_id", "of", "said", "chars", "most").mapInArrow(run, PREFIX)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
    columns = zip(*out) if out else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in PREFIX.split(", ")])


def members_hash(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256): the hash of the ascending ids of the (digest, conv_id), as decimals with commas.

    Ids are sorted by ranges, so those of one digest may lie in many partitions; each writes pieces of text,
    and only these come together, in order.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, out = None, [], []

        def made() -> pa.RecordBatch:
            rows, out[:] = out[:], []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["digest", "first", "ids"])

        for batch in batches:
            for digest, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (digest != at or len(ids) == PIECE):
                    out.append((at, ids[0], ",".join(map(str, ids))))
                    ids = []
                at = digest
                ids.append(conv)
            yield made()
        if ids:
            out.append((at, ids[0], ",".join(map(str, ids))))
        yield made()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for batch in batches:
            done = []
            for digest, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if digest == at:
                    h.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((at, h.hexdigest()))
                at, h = digest, hashlib.sha256(ids.encode())
            yield _pairs(done)
        yield _pairs([] if at is None else [(at, h.hexdigest())])

    ranged = ends.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    made = ranged.mapInArrow(pieces, "digest binary, first long, ids string")
    return made.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashed, "digest binary, ends_sha256 string")


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["digest", "ends_sha256"])


def subtree_sums(links: DataFrame, values: tuple[str, ...], reach: int = REACH, salts: int = 16) -> DataFrame:
    """``links`` (id, up, values) with each value summed over all links below and the link itself.

    ``up`` is the parent's id, null at the top. Each round explodes every link to its ``reach`` - 1 nearest
    ancestors and then goes on with the ``reach``-th one as parent and the sums so far as values.
    """
    links = checkpointed(links.select("id", "up", *values))
    while True:
        # Lists of ancestors, nearest first, double in length until they have ``reach``.
        up = links.select("id", F.when(F.col("up").isNull(), F.array().cast("array<binary>")).otherwise(F.array("up")).alias("above"))
        length = 1
        while length < reach:
            far = F.when(F.size("above") == length, F.element_at("above", -1))
            more = up.select(F.col("id").alias("far"), F.col("above").alias("next"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
            asked = up.withColumn("far", far).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
            up = checkpointed(asked.join(more, ["far", "salt"], "left").select("id", F.when(F.col("next").isNotNull(), F.concat("above", "next")).otherwise(F.col("above")).alias("above")))
            length *= 2
            if up.filter(F.size("above") == length).isEmpty():
                break
        each = links.join(up, "id").select(F.explode(F.concat(F.array("id"), F.slice("above", 1, reach - 1))).alias("id"), *values)
        sums = each.groupBy("id").agg(*[F.sum(v).alias(v) for v in values])
        beyond = up.select("id", F.get("above", F.lit(reach - 1)).alias("up"))
        links = checkpointed(sums.join(beyond, "id").select("id", "up", *values))
        if links.filter("up IS NOT NULL").isEmpty():
            return links.drop("up")


def trie(conversations: DataFrame, reach: int = REACH, salts: int = 16) -> DataFrame:
    """One row for each node of the trie of rebuilt (conv_id, turn, role, text).

    Turns go by turn (nulls first), those of one number by role and the beginning of
    the text (64 characters, then its digest). A null role or text is empty. Turns
    without conv_id belong to no conversation and are left out. An empty table gives an empty result, as
    there is no conversation at the root. Repeated rows are turns like others; other columns aren't looked at.
    """
    each = checkpointed(prefixes(rebuilt(conversations)))
    nodes = each.groupBy("depth", "digest").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("chars").alias("chars"), F.first("run").alias("run"))
    nodes = checkpointed(nodes)
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = checkpointed(nodes.join(children, "digest", "left").fillna(0, ["n_children"]))
    # A chain: the nodes that have the same members have the same smallest one, and there are as many of them.
    chain = nodes.groupBy("conv_id", "n_convs").agg(
        F.min(F.struct("depth", "parent", (F.col("run") - F.col("chars")).alias("run"))).alias("top"),
        F.max(F.struct("depth", "digest", "run", "n_children")).alias("end"),
    )
    chain = chain.select("conv_id", "n_convs", F.col("top.parent").alias("parent"), F.col("top.depth").alias("top_depth"), F.col("top.run").alias("before"), F.col("end.digest").alias("id"), F.col("end.run").alias("after"), (F.col("end.n_children") == 0).cast("long").alias("leaf"))
    chain = checkpointed(chain)
    # Above a chain's first node stands the last one of another chain, as that node's members part there or end.
    links = chain.select("id", F.col("parent").alias("up"), "leaf", ((F.col("n_convs") - 1) * (F.col("after") - F.col("before"))).alias("saved"))
    sums = subtree_sums(links, ("leaf", "saved"), reach, salts)
    holders = chain.select(F.col("id").alias("parent"), F.col("conv_id").alias("above"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = chain.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    known = salted.join(holders, ["parent", "salt"], "left").join(sums.withColumnRenamed("leaf", "leaves"), "id")
    known = known.select("conv_id", "n_convs", "top_depth", "above", "before", "leaves", "saved")
    found = nodes.join(known, ["conv_id", "n_convs"]).join(members_hash(each.filter("ends").select("digest", "conv_id")), "digest", "left")
    over = (F.col("n_convs") - 1) * (F.col("run") - F.col("chars") - F.col("before"))  # what the chain's nodes above this one save
    return found.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") == F.col("top_depth"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - over).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_prefixes(spark, sf_dir):
    """Every node of the prefix trie of all conversations."""
    return trie(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, {crc("conv_id::VARCHAR")} % 6 AS h FROM turns
), parts AS (
  SELECT i.conv_id, 0 AS of, t.k, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.base AND t.k <= i.h
  UNION ALL
  SELECT i.conv_id, 1, t.k, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.k > i.h
), placed AS (
  SELECT conv_id, row_number() OVER w AS d, sha256(role || chr(0) || text) AS said, length(text) AS chars
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY of, k)
), whole AS (
  SELECT i.conv_id, coalesce(list(said ORDER BY d) FILTER (said IS NOT NULL), []) AS path, coalesce(list(chars ORDER BY d) FILTER (said IS NOT NULL), []) AS sizes
  FROM ids i LEFT JOIN placed p ON p.conv_id = i.conv_id GROUP BY i.conv_id
), prefixed AS (
  SELECT conv_id, d, array_to_string(path[1:d], '') AS prefix, coalesce(sizes[d], 0) AS chars, len(path) AS n
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM whole)
), nodes AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM prefixed GROUP BY d, prefix
), children AS (
  SELECT left(prefix, 64 * (d - 1)) AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), full_nodes AS (
  SELECT a.*, coalesce(c.n, 0) AS n_children, p.conv_id AS parent_conv_id
  FROM nodes a LEFT JOIN children c ON c.prefix = a.prefix
  LEFT JOIN nodes p ON a.d > 0 AND p.d = a.d - 1 AND p.prefix = left(a.prefix, 64 * (a.d - 1))
), sums AS (
  SELECT left(prefix, 64 * up) AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM full_nodes) GROUP BY 1
)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM full_nodes JOIN sums USING (prefix)
"""
