"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

Turns get positions by ranges of (conversation, turn), so a conversation of any length is numbered by many tasks.  A
prefix is named by the exclusive-or of 128-bit digests of (position, role, text), which a running window gives; equal
sequences have equal names.  A node is a depth and a name; it carries the smallest conversation that starts with it.

Totals: a round first rakes, then compresses.  Rake removes all leaves and adds what they hold to their parents.
Compress takes nodes with a single child out of chains: of two neighbours in a chain the upper one goes if its coin falls
so and the lower one's doesn't, and the child then hangs from the grandparent, with what the removed node held on its
edge.  Both are joins on keys; a tree of any shape is gone after a number of rounds that grows with the logarithm of its
nodes, so a conversation of a million turns needs no million steps.  Removed chain nodes are re-expanded from the last
round to the first: their total is that of the child they were joined to and what they held.

The digest of the conversations that end at a node needs them in order: they are sorted by ranges, written as decimal
blocks by many tasks, and each node's blocks are streamed through SHA-256, one block in memory at a time.

Turns are ordered by turn (null first), then role, then text; null role or text counts as empty; repeated rows are turns
of their own.  Rows without a conversation id belong to no conversation and give nothing.  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.common import stored

#: Turns that a rebuilt conversation may take over: the remainder of its hash by this.
SHARED = 6
#: Conversations that share a first one.
FAMILY = 100
#: Bytes of a block of conversation ids.
BLOCK_BYTES = 1 << 18
#: Rounds after which contraction is taken to have failed; far above what any table needs.
MOST_ROUNDS = 200
#: What subtrees are summed over.
VALUES = ("leaves", "saved")


def numbered(turns: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``turns`` with ``pos``, the place (from 1) of each row within its group by ``order``: row numbers within ranges of
    the whole order, and the sizes of the group's earlier ranges added."""
    spark = turns.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = turns.repartitionByRange(n, group, *[F.col(c).asc_nulls_first() for c in order])
    ranged = stored(ranged.withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(group, "_range").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return (
        ranged.withColumn("_at", F.row_number().over(within))
        .join(starts, [group, "_range"])
        .withColumn("pos", F.col("_start") + F.col("_at"))
        .drop("_range", "_at", "_start")
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, role, text, own rows of turnless conversations with depth 0): each conversation with the first
    turns of its family's first one."""
    clean = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    placed = stored(numbered(clean, "conv_id", ["turn", "role", "text"]), "turns")
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = placed.groupBy("conv_id").agg(F.max("pos").alias("own")).select(
        "conv_id", "own", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % SHARED).alias("h")
    )
    first = placed.where(F.col("pos") < SHARED)
    heads = first.groupBy("conv_id").agg(F.max("pos").alias("have")).select(F.col("conv_id").alias("base"), "have")
    convs = convs.join(heads, "base", "left").select(
        "conv_id", "own", "base", "h", F.least("h", F.coalesce("have", F.lit(0))).alias("taken")
    )
    convs = stored(convs, "conversations")
    shared = first.select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "role", "text")
    taken = convs.join(shared, "base").where(F.col("depth") <= F.col("taken")).select("conv_id", "depth", "role", "text")
    kept = placed.join(convs.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") > F.col("h"))
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "role", "text")
    none = convs.where((F.col("taken") == 0) & (F.col("own") <= F.col("h")))
    bare = none.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    return taken.unionByName(kept).unionByName(bare)


def _halves(digest: F.Column) -> list[F.Column]:
    """Two longs of a hexadecimal digest of 128 bits."""
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17)]


def trie_nodes(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (conv_id, depth from 1 (0: no turns), role, text), nodes (depth, conv_id, parent_conv_id, n_convs, chars)
    and ends (depth, conv_id, member): the node at which each conversation ends."""
    role, text = F.col("role"), F.col("text")
    digest = F.md5(F.concat_ws(":", "depth", F.length(role), role, text))
    turns = sequences.where(F.col("depth") > 0).select("conv_id", "depth", F.length(text).cast("long").alias("chars"), digest.alias("_d"))
    a, b = _halves(F.col("_d"))
    turns = stored(turns.select("conv_id", "depth", "chars", a.alias("a"), b.alias("b")), "digests")

    # running exclusive-or by blocks of positions, so that a long conversation isn't one task's
    block = F.floor((F.col("depth") - 1) / 1024).alias("_block")
    blocks = turns.groupBy("conv_id", block).agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.where("_block >= 0").select(
        "conv_id", "_block", *[F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in "ab"]
    )
    upto = Window.partitionBy("conv_id", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = turns.withColumn("_block", block).select("*", *[F.bit_xor(c).over(upto).alias(f"r{c}") for c in "ab"])
    prefixes = prefixes.join(blocks, ["conv_id", "_block"]).select(
        "conv_id", "depth", "chars",
        *[F.col(f"r{c}").bitwiseXOR(F.col(f"_{c}")).alias(f"p{c}") for c in "ab"],
        *[F.col(f"r{c}").bitwiseXOR(F.col(f"_{c}")).bitwiseXOR(F.col(c)).alias(f"q{c}") for c in "ab"],
    )
    prefixes = stored(prefixes, "prefixes")

    nodes = prefixes.groupBy("depth", "pa", "pb").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"),
        F.first("qa").alias("qa"), F.first("qb").alias("qb"),
    )
    nodes = stored(nodes, "nodes")
    everyone = sequences.select("conv_id").distinct()
    root = stored(everyone.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0"), "root")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("pa").alias("qa"), F.col("pb").alias("qb"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(up, ["depth", "qa", "qb"]).select("depth", "conv_id", "parent_conv_id", "n_convs", "chars")
    top = nodes.where("depth = 1").crossJoin(F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id"))))  # one row
    top = top.select("depth", "conv_id", "parent_conv_id", "n_convs", "chars")
    bottom = root.select(F.lit(0).cast("long").alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.lit(0).cast("long").alias("chars"))
    tree = stored(deep.unionByName(top).unionByName(bottom), "trie")

    lengths = sequences.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    last = lengths.join(prefixes.select("conv_id", "depth", "pa", "pb"), ["conv_id", "depth"])
    ended = last.withColumnRenamed("conv_id", "member").join(nodes.select("depth", "pa", "pb", "conv_id"), ["depth", "pa", "pb"])
    turnless = lengths.where("depth = 0").select("depth", F.col("conv_id").alias("member")).crossJoin(F.broadcast(root.select("conv_id")))
    ends = ended.select("depth", "conv_id", "member").unionByName(turnless.select("depth", "conv_id", "member"))
    return tree, ends


def _coin(round_no: int, *key: str) -> F.Column:
    return F.xxhash64(*key, F.lit(round_no)).bitwiseAND(F.lit(1).cast("long")) == 1


def subtree_sums(tree: DataFrame, values: tuple[str, ...] = VALUES) -> DataFrame:
    """From a forest (depth, conv_id) -> (up_depth, up_conv; null for roots) with ``values`` of each node, the sums of each
    node's subtree, by rake and compress."""
    me, up = ["depth", "conv_id"], ["up_depth", "up_conv"]
    alive = tree.select(*me, *up, *values, *[F.lit(0).cast("long").alias(f"e_{v}") for v in values])
    done, removed = [], []
    parent_key = [F.col(b).alias(a) for a, b in zip(me, up)]
    for round_no in range(MOST_ROUNDS):
        alive = stored(alive, "alive")
        if alive.isEmpty():
            break
        # rake: nodes without children
        kids = alive.where("up_depth IS NOT NULL").select(*parent_key).groupBy(*me).agg(F.count("*").alias("kids"))
        seen = stored(alive.join(kids, me, "left"), "seen")
        leaves = seen.where("kids IS NULL")
        done.append(leaves.select(*me, *values))
        given = leaves.where("up_depth IS NOT NULL").groupBy(*[F.col(b).alias(a) for a, b in zip(me, up)]).agg(
            *[F.sum(F.col(v) + F.col(f"e_{v}")).alias(f"g_{v}") for v in values]
        )
        rest = seen.where("kids IS NOT NULL").drop("kids")
        child = rest.where("up_depth IS NOT NULL").groupBy(*[F.col(b).alias(a) for a, b in zip(me, up)]).agg(
            F.count("*").alias("kids"), F.min(F.struct("depth", "conv_id")).alias("child")
        )
        rest = rest.join(given, me, "left").join(child, me, "left")
        rest = rest.select(
            *me, *up, *[(F.col(v) + F.coalesce(F.col(f"g_{v}"), F.lit(0))).alias(v) for v in values], *[f"e_{v}" for v in values],
            F.when((F.col("kids") == 1) & F.col("up_depth").isNotNull(), F.col("child")).alias("child"),
        )
        rest = stored(rest, "raked")
        # compress: nodes with one child whose coin says so, above a node that stays
        lower = rest.select(
            F.col("depth").alias("c_depth"), F.col("conv_id").alias("c_conv"),
            (F.col("child").isNull() | ~_coin(round_no, *me)).alias("stays"), *[F.col(f"e_{v}").alias(f"c_{v}") for v in values],
        )
        upper = rest.where(F.col("child").isNotNull() & _coin(round_no, *me)).withColumns({"c_depth": F.col("child.depth"), "c_conv": F.col("child.conv_id")})
        out = upper.join(lower, ["c_depth", "c_conv"]).where("stays")
        out = stored(
            out.select(
                *me, *up, "c_depth", "c_conv",
                *[(F.col(v) + F.col(f"c_{v}")).alias(f"t_{v}") for v in values],  # total less the child's
                *[(F.col(v) + F.col(f"e_{v}")).alias(f"n_{v}") for v in values],  # what the child's edge takes over
            ),
            "compressed",
        )
        removed.append(out)
        moved = out.select(
            F.col("c_depth").alias("depth"), F.col("c_conv").alias("conv_id"), F.col("up_depth").alias("m_depth"), F.col("up_conv").alias("m_conv"),
            *[f"n_{v}" for v in values],
        )
        alive = rest.drop("child").join(out.select(*me), me, "left_anti").join(moved, me, "left")
        alive = alive.select(
            *me, F.coalesce("m_depth", "up_depth").alias("up_depth"), F.coalesce("m_conv", "up_conv").alias("up_conv"), *values,
            *[(F.col(f"e_{v}") + F.coalesce(F.col(f"n_{v}"), F.lit(0))).alias(f"e_{v}") for v in values],
        )
    else:
        raise RuntimeError(f"the tree did not contract in {MOST_ROUNDS} rounds")

    totals = tree.select(*me, *values).limit(0)
    for part in done:
        totals = totals.unionByName(part)
    for out in reversed(removed):  # a child went in a later round than the node above it
        of_child = totals.select(F.col("depth").alias("c_depth"), F.col("conv_id").alias("c_conv"), *values)
        again = out.join(of_child, ["c_depth", "c_conv"]).select(*me, *[(F.col(f"t_{v}") + F.col(v)).alias(v) for v in values])
        totals = totals.unionByName(stored(again, "expanded"))
    return totals


def end_digests(ends: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """From ends (depth, conv_id, member), (depth, conv_id, ends_sha256): SHA-256 of each node's members in ascending
    order, as decimals with commas between."""
    spark = ends.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, None, [], 0
        rows: list[tuple] = []

        def out():
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            return pa.RecordBatch.from_arrays(cols, ["depth", "conv_id", "first", "ids"])

        for batch in batches:
            for depth, conv, member in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, conv) != key or size > block_bytes:
                    if held:
                        rows.append((*key, first, ",".join(held)))
                    key, first, held, size = (depth, conv), member, [], 0
                s = str(member)
                held.append(s)
                size += len(s) + 1
            if len(rows) > 5000:
                yield out()
                rows = []
        if held:
            rows.append((*key, first, ",".join(held)))
        if rows:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, rows = None, None, []

        def out():
            cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
            return pa.RecordBatch.from_arrays(cols, ["depth", "conv_id", "ends_sha256"])

        for batch in batches:
            for depth, conv, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if (depth, conv) == key:
                    h.update(b"," + ids.encode())
                else:
                    if key:
                        rows.append((*key, h.hexdigest()))
                    key, h = (depth, conv), hashlib.sha256(ids.encode())
            if len(rows) > 5000:
                yield out()
                rows = []
        if key:
            rows.append((*key, h.hexdigest()))
        if rows:
            yield out()

    order = ["depth", "conv_id", "member"]
    ranged = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    cut = stored(ranged.mapInArrow(blocks, "depth long, conv_id long, first long, ids string"), "id-blocks")
    dealt = cut.repartition(n, "depth", "conv_id").sortWithinPartitions("depth", "conv_id", "first")
    return dealt.mapInArrow(digests, "depth long, conv_id long, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node of the trie
    of rebuilt conversations, from (conv_id, turn, role, text)."""
    sequences = stored(rebuilt(turns), "rebuilt")
    tree, ends = trie_nodes(sequences)
    kids = tree.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("n_children"))
    tree = tree.join(kids, ["depth", "conv_id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    tree = stored(tree, "trie-children")
    sums = subtree_sums(
        tree.select(
            "depth", "conv_id", F.when(F.col("depth") > 0, F.col("depth") - 1).alias("up_depth"), F.col("parent_conv_id").alias("up_conv"),
            (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        )
    )
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        tree.join(sums, ["depth", "conv_id"])
        .join(end_digests(ends), ["depth", "conv_id"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
        )
    )


def prefix_trie_sql() -> str:
    """The query's result in SQL: prefixes as lists, subtrees by the smallest member's path."""
    crc = (
        "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
        "lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"
    )
    return f"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        head AS (SELECT conv_id AS base, count(*) AS have FROM t WHERE pos < 6 GROUP BY 1),
        k AS (SELECT c.*, least(h, coalesce(have, 0)) AS taken FROM c LEFT JOIN head USING (base)),
        r AS (SELECT k.conv_id, pos AS depth, role, text FROM k JOIN t ON t.conv_id = k.base AND pos <= taken
              UNION ALL SELECT k.conv_id, pos - h + taken, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND pos > h),
        p AS (SELECT conv_id, depth, text, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS prefix FROM r
              UNION ALL SELECT conv_id, 0, '', '' FROM c),
        m AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS node, count(*) OVER (PARTITION BY depth, prefix) AS n,
                     max(depth) OVER (PARTITION BY conv_id) AS size FROM p),
        nodes AS (SELECT depth, node, any_value(n) AS n, any_value(length(text)) AS chars,
                         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = size), '') AS ended FROM m GROUP BY 1, 2),
        tree AS (SELECT nodes.*, m.node AS parent FROM nodes LEFT JOIN m ON m.conv_id = nodes.node AND m.depth = nodes.depth - 1),
        kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS kids FROM tree WHERE parent IS NOT NULL GROUP BY 1, 2),
        x AS (SELECT tree.*, coalesce(kids, 0) AS kids FROM tree LEFT JOIN kids USING (depth, node)),
        sums AS (SELECT m.depth, m.node, count(*) FILTER (x.kids = 0) AS leaves, sum((x.n - 1) * x.chars)::BIGINT AS saved
                 FROM x JOIN m ON m.conv_id = x.node AND m.depth <= x.depth GROUP BY 1, 2)
        SELECT x.node AS conv_id, x.depth, parent AS parent_conv_id, x.n AS n_convs, x.kids AS n_children, leaves AS n_leaves,
               saved AS saved_tokens, sha256(ended) AS ends_sha256
        FROM x JOIN sums USING (depth, node)"""
