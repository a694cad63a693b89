"""Shared openings of conversations: a prefix trie built by a van Emde Boas recursion.

Sequences of turns are cut at half depth again and again. With depths below
2^k, the cut at depth m belongs to the level of m's lowest bit L: it closes a
segment of L turns that begins at depth m - L, whose own prefix was named a
level before. So a level names all its cut prefixes at once, whatever part of
the trie they lie in: two prefixes are one node if they begin with the same
named prefix and go on with equal segments. A node's name is the smallest
conversation that passes through it, so names stay exact and need no dictionary.

* Upwards, digests of neighbouring segments are joined into those of double length.
* Downwards, each level names its cuts (upper trie first, then the forests below).
* Upwards again, the totals of each lower tree, worked out inside its segment,
  are grafted on to the nodes above its root in the upper segment, which the
  root's own conversation passes through.

Every step is a join or an aggregate of (conversation, depth) rows; log2 of the
depth rounds, each written. Counts are added up before they are shuffled; a
conversation that a third of all have in common is one hot name, whose rows an
adaptive join splits. Long conversations are spread: places are counted from a
range-partitioned order, not in a window. The digest of the conversations that
end at a node runs over pieces of sorted ids, so a task holds one piece at a time.

Defined results: a null role or text is empty. Turns are ordered by number,
null first, then role, then text; repeated rows are turns of their own. Rows
without a conversation id are left out. Very long texts count by digest and
length alone. No conversations, no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.session import written

#: Bytes of a piece of listed conversation ids.
PIECE = 1 << 20


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text) as (conv, g, symbol, chars): g numbers all rows in order, without a window."""
    turn = F.col("turn").asc_nulls_first()
    # Bounds reach the driver, so they hold heads of the texts; a role longer than its head comes after that head.
    heads = (F.substring("role", 1, 32), F.when(F.length("role") <= 32, F.substring("text", 1, 32)).asc_nulls_last())
    symbol = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    laid = written(rows.repartitionByRange("conv", turn, *heads).sortWithinPartitions("conv", turn, "role", "text")
                   .select("conv", symbol.alias("symbol"), F.length("text").cast("long").alias("chars"))
                   .withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before, sizes = 0, []
    for p, n in sorted(tuple(r) for r in laid.groupBy(part.alias("part")).count().collect()):
        sizes.append((p, before))
        before += n
    starts = rows.sparkSession.createDataFrame(sizes, "part long, before long")
    return laid.join(F.broadcast(starts), part == starts["part"]).select(
        "conv", (F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("g"), "symbol", "chars")


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, depth, symbol, chars) of every turn, depth from 1, and (conv, length) of every conversation."""
    rows = turns.where(turns[f"`{conv_id}`"].isNotNull()).select(
        turns[f"`{conv_id}`"].cast("long").alias("conv"), turns[f"`{turn}`"].alias("turn"),
        F.coalesce(turns[f"`{role}`"], F.lit("")).alias("role"), F.coalesce(turns[f"`{text}`"], F.lit("")).alias("text"))
    numbered = _in_order(rows)
    convs = written(numbered.groupBy("conv").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("length")))
    placed = numbered.join(convs, "conv").select("conv", (F.col("g") - F.col("first") + 1).alias("depth"), "symbol", "chars")
    return written(placed), convs.select("conv", "length")


def with_shared_openings(paths: DataFrame, convs: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations begun again: c's first h turns become those of c - c % every, with h = crc32(c) % most.

    The remainder of a negative id is negative, as in SQL.
    """
    lead = convs.select("conv", "length", (F.crc32(F.col("conv").cast("string").cast("binary")) % most).alias("h"),
                        (F.col("conv") - F.col("conv") % every).alias("base"))
    sizes = convs.select(F.col("conv").alias("base"), F.col("length").alias("base_length"))
    lead = written(lead.join(sizes, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("base_length", F.lit(0))).alias("kept"), "length"))
    own = paths.join(lead, "conv").where("depth > h").select(
        "conv", (F.col("depth") - F.col("h") + F.col("kept")).alias("depth"), "symbol", "chars")
    heads = paths.where((F.col("depth") < most) & (F.col("conv") % every == 0)).withColumnRenamed("conv", "base")
    taken = heads.join(lead.select("conv", "base", "h"), "base").where("depth <= h").select("conv", "depth", "symbol", "chars")
    lengths = lead.select("conv", (F.col("kept") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length"))
    return written(own.union(taken)), written(lengths)


def _joined(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(left, right), 256))


def named_prefixes(paths: DataFrame, convs: DataFrame) -> tuple[DataFrame, int]:
    """((conv, depth, name), k): the node of each prefix, depth 0 included; depths are below 2^k."""
    ends = convs.agg(F.max("length"), F.min("conv")).first()
    deepest, root = ends[0] or 0, ends[1]
    k = int(deepest).bit_length()
    # Segments of 2^j turns, number i of a conversation covers depths i * 2^j + 1 to (i + 1) * 2^j.
    levels = [paths.select("conv", (F.col("depth") - 1).alias("i"), F.col("symbol").alias("body"))]
    for _ in range(1, k):
        half = F.col("i") % 2 == 0
        levels.append(written(levels[-1].groupBy("conv", F.shiftright("i", 1).alias("i")).agg(
            F.max(F.when(half, F.col("body"))).alias("l"), F.max(F.when(~half, F.col("body"))).alias("r"))
            .where("l is not null and r is not null").select("conv", "i", _joined(F.col("l"), F.col("r")).alias("body"))))
    names = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("name"))
    for j in reversed(range(k)):
        cuts = levels[j].where("i % 2 = 0").select("conv", F.shiftleft("i", j).alias("start"), "body")
        upper = names.select("conv", F.col("depth").alias("start"), F.col("name").alias("above"))
        cuts = cuts.join(upper, ["conv", "start"])
        least = cuts.groupBy("start", "above", "body").agg(F.min("conv").alias("name"))
        names = names.union(written(cuts.join(least, ["start", "above", "body"]).select(
            "conv", (F.col("start") + (1 << j)).alias("depth"), "name")))
    return written(names), k


def _grafted(nodes: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """(depth, name, leaves, saved): the nodes' own totals, summed over their subtrees."""
    totals = nodes.select("depth", "name", (F.col("n_children") == 0).cast("long").alias("leaves"),
                          ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    for j in range(k):
        segment = F.shiftright("depth", j)
        roots = totals.where((segment % 2 == 1) & (F.col("depth") == F.shiftleft(segment, j))).select(
            F.col("name").alias("conv"), (segment - 1).alias("segment"), "leaves", "saved")
        above = names.where(segment % 2 == 0).select("conv", "depth", "name", segment.alias("segment"))
        more = roots.join(above, ["conv", "segment"]).select("depth", "name", "leaves", "saved")
        totals = written(totals.union(more).groupBy("depth", "name").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    return totals


def _ending(names: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, name, ends): the digest of the sorted ids of the conversations that end at a node."""
    last = convs.select("conv", F.col("length").alias("depth"))
    ends = written(names.join(last, ["conv", "depth"]).select("depth", "name", "conv"))

    def runs(batches):
        """Neighbouring rows of a node as (depth, name, first id, ids in a piece)."""
        key, ids, size, out = None, [], 0, []
        for b in batches:
            for depth, name, conv in zip(*(c.to_pylist() for c in b.columns)):
                if key and (key[:2] != (depth, name) or size > PIECE):
                    out.append((*key, ",".join(ids)))
                    key, ids, size = None, [], 0
                    if len(out) >= 1024 or size_of(out) > 16 * PIECE:
                        yield made(out)
                        out = []
                if key is None:
                    key = depth, name, conv
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if key:
            out.append((*key, ",".join(ids)))
        if out:
            yield made(out)

    def size_of(out):
        return sum(len(o[3]) for o in out)

    def made(out):
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(columns[3])],
                                          ["depth", "name", "first", "ids"])

    def digests(batches):
        """The pieces of a node, in order, as one digest."""
        key, state = None, None
        for b in batches:
            depths, names_, shas = [], [], []
            for depth, name, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)):
                if key == (depth, name):
                    state.update(b",")
                else:
                    if key:
                        depths.append(key[0]), names_.append(key[1]), shas.append(state.hexdigest())
                    key, state = (depth, name), hashlib.sha256()
                state.update(ids.as_py().encode())
            if depths:
                yield pa.RecordBatch.from_arrays([pa.array(depths), pa.array(names_), pa.array(shas)], ["depth", "name", "ends"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], ["depth", "name", "ends"])

    pieces = written(ends.repartitionByRange("depth", "name", "conv").sortWithinPartitions("depth", "name", "conv")
                     .mapInArrow(runs, "depth long, name long, first long, ids string"))
    return (pieces.repartition("depth", "name").sortWithinPartitions("depth", "name", "first")
            .mapInArrow(digests, "depth long, name long, ends string"))


def trie(paths: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes, and (conv, depth, name) of every prefix.

    Nodes: name (the smallest conversation), depth, parent, n_convs, n_children,
    n_leaves, saved (code points of repeated last texts in the subtree), ends.
    """
    names, k = named_prefixes(paths, convs)
    counted = names.groupBy("depth", "name").agg(F.count(F.lit(1)).alias("n_convs"))
    none = F.lit(None).cast("long")
    # One shuffle brings a node its last text's length and its parent: both are found at its own conversation.
    facts = (counted.select(F.col("name").alias("conv"), "depth", "n_convs", none.alias("chars"), none.alias("parent"))
             .union(paths.select("conv", "depth", none, "chars", none))
             .union(names.select("conv", F.col("depth") + 1, none, none, "name")))
    nodes = written(facts.groupBy("conv", "depth").agg(*[F.max(c).alias(c) for c in ("n_convs", "chars", "parent")])
                    .where("n_convs is not null").select(
                        F.col("conv").alias("name"), "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"),
                        "n_convs", F.coalesce("chars", F.lit(0)).alias("chars")))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("name")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    totals = _grafted(nodes, names, k)
    whole = nodes.join(totals, ["depth", "name"]).join(_ending(names, convs), ["depth", "name"], "left")
    return whole.select("name", "depth", "parent", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), "saved",
                        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends")), names
