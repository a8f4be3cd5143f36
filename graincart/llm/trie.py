"""The prefix trie of conversations, its subtree totals by parallel tree contraction.

A node is a sequence of first turns, and is named by its smallest member and its depth. Turns are
numbered and their hashes summed along a conversation in bins, so that a conversation of any length
is never one group; as each hash has the turn's place in it, a prefix sum tells its prefix.

Contraction runs in rounds of joins. Rake takes all leaves away and adds their totals to their
parents. Compress takes nodes with one child out of their chains: those whose depth comes first,
in a fixed order of depths, among their parent's and their child's, which are every other node of a
fresh chain. The edge over a node that is gone keeps what it had. When only the root was left, the
rounds are walked back: the total of a node taken out of a chain is that of its child of that round
and what lay between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graincart.llm.common import discard, join_spread, materialize, small_batches

SPACE = r"[^\x20\x09-\x0D]+"
#: Turns of one conversation that are summed together, and bits of the conversation ids that are joined as one text.
BIN, CHUNK_BITS = 4096, 13
#: Conversations that share their first turns with the first of them, and how many turns at most but for one.
SHARED, TURNS = 20, 4
ROOT = "0:0:0"


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its SHARED."""
    return F.crc32(conv_id.cast("string")) % TURNS


def _first_of(conv_id: Column) -> Column:
    return conv_id - conv_id % SHARED


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, at, a, b, words), and parts of conversations (conv_id, part, rows, before, size).

    Turns are dealt over ranges of the order (conv_id, turn, hash of the turn), numbered within
    their range, and ``before`` is how many turns of the conversation earlier ranges have.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(F.regexp_extract_all(text, F.lit(SPACE), F.lit(0))).cast("long")
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"), F.xxhash64(F.lit(2), role, text).alias("b"), words.alias("words")
    )
    order = ["turn", "a", "b"]
    dealt = materialize(turns.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy("part")
    whole = Window.partitionBy("conv_id")
    parts = materialize(parts.select("conv_id", "part", "rows", (F.sum("rows").over(earlier) - F.col("rows")).alias("before"), F.sum("rows").over(whole).alias("size")))
    within = Window.partitionBy("conv_id", "part").orderBy(*order)
    return dealt.withColumn("at", F.row_number().over(within).cast("long")), parts


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Turns (conv_id, depth, a, b, words, last) of the rebuilt conversations, the conversations (conv_id, depth),
    and the tables that both read."""
    turns, parts = numbered(conversations)
    turns = materialize(turns)
    convs = parts.where("before = 0").select("conv_id", "size", shared_turns(F.col("conv_id")).alias("own_from"))
    firsts = convs.where(F.col("conv_id") % SHARED == 0).select(F.col("conv_id").alias("first"), F.col("size").alias("first_size"))
    convs = convs.withColumn("first", _first_of(F.col("conv_id"))).join(firsts.hint("merge"), "first", "left")
    taken = F.least("own_from", F.coalesce("first_size", F.lit(0)))
    convs = convs.select("conv_id", "first", "size", "own_from", taken.alias("taken"))
    convs = materialize(convs.withColumn("depth", F.greatest(F.col("size") - F.col("own_from"), F.lit(0)) + F.col("taken")))
    # a row for each range of a conversation, so that turns of a long one meet in as many tasks as they are in
    parts_of = parts.select("conv_id", "part", "before").join(convs.hint("merge"), "conv_id")
    own = turns.join(parts_of.hint("merge"), ["conv_id", "part"]).withColumn("at", F.col("at") + F.col("before")).where("at > own_from")
    own = own.select("conv_id", (F.col("at") - F.col("own_from") + F.col("taken")).alias("depth"), "a", "b", "words", (F.col("at") == F.col("size")).alias("last"))
    heads = turns.where((F.col("conv_id") % SHARED == 0) & (F.col("at") < TURNS)).join(parts.where(F.col("before") < TURNS).select("conv_id", "part", "before").hint("merge"), ["conv_id", "part"])
    heads = heads.select(F.col("conv_id").alias("first"), (F.col("at") + F.col("before")).alias("at"), "a", "b", "words").where(F.col("at") < TURNS)
    taken_turns = convs.where("taken > 0").select("conv_id", "first", "taken", F.col("depth").alias("end")).join(heads.hint("merge"), "first").where("at <= taken")
    taken_turns = taken_turns.select("conv_id", F.col("at").alias("depth"), "a", "b", "words", (F.col("at") == F.col("end")).alias("last"))
    return own.union(taken_turns), convs.select("conv_id", "depth"), [turns, parts, convs]


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, depth, a, b, words, last) with ``key`` of the node at that depth and ``above``, its parent's."""
    hashed = turns.select("conv_id", "depth", "words", "last", *[F.xxhash64(F.lit(n), "depth", "a", "b").cast("decimal(38,0)").alias(n) for n in ("s", "t")])
    hashed = materialize(hashed.withColumn("bin", F.expr(f"depth div {BIN}")))
    bins = hashed.groupBy("conv_id", "bin").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    earlier = Window.partitionBy("conv_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # only conversations that reach a second bin have sums to be carried
    bins = bins.join(hashed.where("bin > 0").select("conv_id").distinct().hint("merge"), "conv_id", "left_semi")
    bins = bins.select("conv_id", "bin", F.sum("s").over(earlier).alias("s0"), F.sum("t").over(earlier).alias("t0")).where("bin > 0")
    within = Window.partitionBy("conv_id", "bin").orderBy("depth")
    run = hashed.withColumn("ss", F.sum("s").over(within)).withColumn("tt", F.sum("t").over(within)).join(bins.hint("merge"), ["conv_id", "bin"], "left")
    ss, tt = (F.col(f"{n}{n}") + F.coalesce(f"{n}0", F.lit(0)) for n in "st")
    name = lambda depth, s, t: F.concat_ws(":", depth.cast("string"), s.cast("decimal(38,0)").cast("string"), t.cast("decimal(38,0)").cast("string"))
    return run.select("conv_id", "depth", "words", "last", name(F.col("depth"), ss, tt).alias("key"), name(F.col("depth") - 1, ss - F.col("s"), tt - F.col("t")).alias("above"))


def nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(key, conv_id, depth, parent_conv_id, n_convs, n_children, words), a row for each node of the trie."""
    found = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("above").alias("above"), F.count("*").alias("n_convs"), F.first("words").alias("words"))
    root = convs.agg(F.lit(ROOT).alias("key"), F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("above"), F.count("*").alias("n_convs"), F.lit(0).cast("long").alias("words"))
    found = materialize(found.select("key", "conv_id", "depth", "above", "n_convs", "words").union(root.where("conv_id is not null")))
    children = materialize(found.where("above is not null").groupBy("above").agg(F.count("*").alias("rows")))
    total = found.count()
    names = found.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    out = join_spread(found, names, "above", children, total, "left")
    out = out.join(children.select(F.col("above").alias("key"), F.col("rows").alias("n_children")).hint("merge"), "key", "left")
    out = materialize(out.select("key", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "words"))
    discard(found, children)
    return out


def _place(depth: Column) -> Column:
    """The order in which depths are taken out of a chain: odd ones first, then odd multiples of 2, of 4 and so on; ties in a mixed order."""
    return F.struct(F.bit_count(depth.bitwiseAND(-depth) - 1), F.xxhash64(depth))


def subtree_totals(tree: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """(conv_id, depth) and the total of each column of ``sums`` over the subtree of each node of ``tree``.

    ``tree`` has conv_id, depth, parent_conv_id (null for the root), parent_depth, n_children and
    ``sums``; depths rise from parent to child. The number of rounds grows with the logarithm of the
    number of nodes. Each round's tables are written; what is walked back at a round is only what
    later rounds took away, so that all rounds together read a multiple of the tree.
    """
    key, up = ["conv_id", "depth"], ["parent_conv_id", "parent_depth"]
    edge = [f"edge_{c}" for c in sums]
    left = materialize(tree.select(*key, *up, F.col("n_children").alias("kids"), *sums, *[F.lit(0).cast("long").alias(e) for e in edge]))
    raked, spliced = [], []
    while left.limit(1).count():
        # rake: leaves are done
        leaves = materialize(left.where("kids = 0").select(*key, *up, *sums, *edge))
        raked.append(leaves)
        gains = leaves.where("parent_conv_id is not null").groupBy(*up).agg(F.count("*").alias("gone"), *[F.sum(F.col(c) + F.col(e)).alias(f"gain_{c}") for c, e in zip(sums, edge, strict=True)])
        gains = gains.withColumnsRenamed({"parent_conv_id": "conv_id", "parent_depth": "depth"})
        grown = left.where("kids > 0").join(gains.hint("merge"), key, "left")
        grown = grown.select(*key, *up, (F.col("kids") - F.coalesce("gone", F.lit(0))).alias("kids"), *[(F.col(c) + F.coalesce(f"gain_{c}", F.lit(0))).alias(c) for c in sums], *edge)
        grown = materialize(grown)
        discard(left)
        # compress: a chosen node of one child has no chosen neighbour
        chosen = grown.where((F.col("kids") == 1) & F.col("parent_conv_id").isNotNull() & (_place(F.col("depth")) < _place(F.col("parent_depth"))))
        chosen = chosen.select(*[F.col(c).alias(f"u_{c}") for c in (*key, *up, *sums, *edge)])
        met = grown.join(chosen.hint("merge"), (F.col("parent_conv_id") == F.col("u_conv_id")) & (F.col("parent_depth") == F.col("u_depth")), "left")
        out = F.col("u_conv_id").isNotNull() & ((F.col("kids") != 1) | (_place(F.col("u_depth")) < _place(F.col("depth"))))
        met = materialize(met.withColumn("out", out))
        gone = met.where("out").select(F.col("u_conv_id").alias("conv_id"), F.col("u_depth").alias("depth"), F.col("conv_id").alias("below_conv_id"), F.col("depth").alias("below_depth"), *[(F.col(f"u_{c}") + F.col(e)).alias(c) for c, e in zip(sums, edge, strict=True)])
        gone = materialize(gone)
        spliced.append(gone)
        parents = [F.when(F.col("out"), F.col(f"u_{c}")).otherwise(F.col(c)).alias(c) for c in up]
        edges = [F.when(F.col("out"), F.col(e) + F.col(f"u_{c}") + F.col(f"u_{e}")).otherwise(F.col(e)).alias(e) for c, e in zip(sums, edge, strict=True)]
        left = materialize(met.select(*key, *parents, "kids", *sums, *edges).join(gone.select(*key).hint("merge"), key, "left_anti"))
        discard(grown, met)
    discard(left)
    # walk back: a round's nodes need only the totals of nodes that later rounds took away
    totals, written = None, []
    for leaves, gone in zip(reversed(raked), reversed(spliced), strict=True):
        done = leaves.select(*key, *sums)
        if totals is not None:
            below = totals.select(F.col("conv_id").alias("below_conv_id"), F.col("depth").alias("below_depth"), *[F.col(c).alias(f"below_{c}") for c in sums])
            opened = gone.join(below.hint("merge"), ["below_conv_id", "below_depth"]).select(*key, *[(F.col(c) + F.col(f"below_{c}")).alias(c) for c in sums])
            opened = materialize(opened)
            written.append(opened)
            done = done.union(opened)
        totals = done if totals is None else totals.union(done)
    if totals is None:
        return tree.select(*key, *sums)
    out = materialize(totals)
    discard(*raked, *spliced, *written)
    return out


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of the comma-joined texts of each key, whose rows come together and in order."""
    key, held = None, None
    for batch in batches:
        done = []
        for k, ids in zip(batch["key"], batch["ids"], strict=True):
            if k != key:
                if held:
                    done.append((key, held.hexdigest()))
                key, held = k, hashlib.sha256(ids.encode())
            else:
                held.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["key", "ends_sha256"])
    if held:
        yield pd.DataFrame([(key, held.hexdigest())], columns=["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) from (key, conv_id): the SHA-256 of the ids of each key, in order and comma-joined.

    Ids are joined within ranges of 2**CHUNK_BITS ids, at most so many in one row. As SHA-256 is a
    chain, one task reads the ranges of a key one after another, and holds one batch of them.
    """
    chunks = ends.groupBy("key", F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
    chunks = chunks.agg(F.array_join(F.transform(F.sort_array(F.collect_set("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    small_batches(ends.sparkSession)
    return chunks.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids").mapInPandas(_digest, "key string, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text), a row for each node; all columns but the last are long.

    conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256, as the contract of this query has them. Turns go by turn, nulls
    first, and turns that tie by a hash of role and text; repeated rows are turns of their own. Null
    roles and texts are empty; rows without conv_id belong to no conversation and are left out.
    Texts of any length count whole. An empty table has no conversation, hence no node. Other
    columns are ignored.
    """
    turns, convs, read = rebuilt(conversations)
    rows, convs = materialize(prefixes(turns)), materialize(convs)
    discard(*read)
    tree = nodes(rows, convs)
    ends = rows.where("last").select("key", "conv_id").union(convs.where("depth = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    digests = materialize(end_digests(ends))
    discard(rows, convs)
    own = tree.select(
        "conv_id", "depth", "parent_conv_id", F.when(F.col("depth") > 0, F.col("depth") - 1).alias("parent_depth"), "n_children",
        (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    totals = subtree_totals(own, ("n_leaves", "saved_tokens"))
    out = tree.join(totals.hint("merge"), ["conv_id", "depth"]).join(digests.hint("merge"), "key", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
