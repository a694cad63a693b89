"""SimHash near-duplicates through vantage-point trees.

A document's fingerprint is the bitwise majority of the XXH64 values of its
word shingles. Equal fingerprints are one class; different ones are linked if
they differ in at most ``max_distance`` bits, found in three steps:

* A tree over Hamming distance is fitted to a sample of the fingerprints, of
  bounded size. Each node has a vantage point and a cut; what is nearer goes
  left, the rest right. By the triangle inequality a pair that a cut parts has
  its near side within ``max_distance`` below the cut, so those fingerprints
  go to both sides, and every close pair meets in at least one shard.
* Each shard is searched by a tree of its own in one task, whose points come
  from the shard itself. Small leaves are compared directly. Only spanning
  links leave a task (each point to the smallest of its local component), so a
  group of n near copies yields at most n - 1 rows, never its pairs.
* The links are joined into components by alternating stars.

The search is exact: the sample decides only how even the shards are.

Defined results: a null or wordless text has fingerprint zero and is linked as
any other. Rows with the same id and text are one document, of which
``drop_copies`` leaves one row (any, if other columns differ). Null ids take part; a class of nothing else has a null id. Extra
columns are handed through by ``drop_copies``; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import written

from .common import text_key, texts_in

SHINGLE = 3
MAX_DISTANCE = 2
SEED = 42
#: Fingerprints that a shard should hold, and sampled ones for each shard.
SHARD_ROWS = 2048
SAMPLES_EACH = 32
MOST_LEVELS = 16
LEAF = 192


def fingerprint(words: list[bytes], k: int = SHINGLE) -> int:
    """The majority bits of the shingles' hashes; zero without words."""
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(k))) if len(words) >= k else [words]
    hashed = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 1 << 16):
        block = hashed[at:at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashed), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fp): ``fp`` holds the 64 bits as a signed long."""
    rows = docs.select(*text_key(docs, text, doc_id), docs[f"`{text}`"].cast("binary").alias("__text"))

    def run(batches):
        for b in batches:
            found = [fingerprint(t.lower().split(), k) if t else 0 for t in texts_in(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array(found, np.uint64).view(np.int64))],
                ["doc_id", "text_key", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


# ------------------------------------------------------------------ the tree


def _cut(points: np.ndarray, radius: int, rng) -> tuple[int, int]:
    """A vantage point and a cut, of a few tried the one with least near the cut."""
    best = None
    for at in rng.choice(len(points), min(5, len(points)), replace=False):
        d = np.bitwise_count(points ^ points[at])
        for cut in (int(np.median(d)), int(np.median(d)) - 1):
            right = np.count_nonzero(d > cut)
            cost = max(np.count_nonzero(d <= cut), np.count_nonzero(d > cut - radius))
            if right and right < len(points) and (best is None or cost < best[0]):
                best = cost, int(points[at]), cut
    return best[1:] if best else (int(points[0]) if len(points) else 0, radius)


def fit_tree(sample: np.ndarray, levels: int, radius: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(vantage points, cuts) of a full tree, the children of i at 2i+1 and 2i+2."""
    nodes = (1 << levels) - 1
    vantage, cuts = np.zeros(nodes, np.uint64), np.full(nodes, 32, np.int16)
    rng, held = np.random.default_rng(SEED), {0: np.sort(sample.astype(np.uint64))}
    for i in range(nodes):
        points = held.pop(i, sample[:0].astype(np.uint64))
        if len(points) < 2:
            vantage[i] = np.uint64(rng.integers(0, 1 << 63))
        else:
            vantage[i], cuts[i] = _cut(points, radius, rng)
        d = np.bitwise_count(points ^ vantage[i]).astype(np.int16)
        held[2 * i + 1], held[2 * i + 2] = points[d <= cuts[i]], points[d > cuts[i]]
    return vantage, cuts


def route(points: np.ndarray, tree, levels: int, radius: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """(index of the point, shard), one for each shard whose bounds the point's ball reaches."""
    vantage, cuts = tree
    at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    for _ in range(levels):
        d = np.bitwise_count(points[at] ^ vantage[node]).astype(np.int16)
        left, right = d <= cuts[node], d > cuts[node] - radius
        at = np.concatenate([at[left], at[right]])
        node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return at, node - ((1 << levels) - 1)


# ------------------------------------------------------------- inside a shard


def _spread(points: np.ndarray, at: np.ndarray, radius: int, parent: np.ndarray) -> None:
    """Join the components of a leaf that cannot be cut: one row of distances at a time."""
    left = at
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            p = front.pop()
            near = np.bitwise_count(points[left] ^ points[p]) <= radius
            for q in left[near]:
                _union(parent, p, q)
            front.extend(left[near])
            left = left[~near]


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _union(parent: np.ndarray, x: int, y: int) -> None:
    x, y = _find(parent, x), _find(parent, y)
    if x != y:
        parent[max(x, y)] = min(x, y)


def local_roots(points: np.ndarray, radius: int = MAX_DISTANCE, leaf: int = LEAF) -> np.ndarray:
    """For sorted, distinct points: the index of the smallest one of each point's component."""
    parent, rng = np.arange(len(points)), np.random.default_rng(SEED)
    work = [np.arange(len(points))]
    while work:
        at = work.pop()
        own = points[at]
        if len(at) <= leaf:
            close = np.bitwise_count(own[:, None] ^ own) <= radius
            if np.count_nonzero(close) > len(at):
                for i, j in np.argwhere(np.triu(close, 1)):
                    _union(parent, at[i], at[j])
            continue
        vantage, cut = _cut(own, radius, rng)
        d = np.bitwise_count(own ^ np.uint64(vantage)).astype(np.int16)
        near, far = at[d <= cut], at[d > cut - radius]
        # A cut that leaves one side whole, or copies nearly all, would not end or not pay.
        if max(len(near), len(far)) == len(at) or len(near) + len(far) > 1.8 * len(at):
            _spread(points, at, radius, parent)
        else:
            work += [near, far]
    return np.array([_find(parent, i) for i in range(len(parent))])


def links(reps: DataFrame, max_distance: int = MAX_DISTANCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(u, v), u > v: links that span the components of the distinct ``fp`` of ``reps``."""
    spark = reps.sparkSession
    count = reps.count()
    levels = min(MOST_LEVELS, max(0, int(np.ceil(np.log2(max(1, count) / shard_rows)))))
    wanted = SAMPLES_EACH << levels
    share = min(1 << 30, int(np.ceil(wanted / max(1, count) * (1 << 30))))
    # At most two million longs at 16 levels: the bound of what the driver sees and sends.
    sample = reps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < share).select("fp").toPandas()["fp"]
    tree = fit_tree(sample.to_numpy(np.int64).view(np.uint64), levels, max_distance)
    sent = spark.sparkContext.broadcast(tree)

    def shards(batches):
        for b in batches:
            points = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, shard = route(points, sent.value, levels, max_distance)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(points[at].view(np.int64))], ["shard", "fp"])

    def search(found: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(found["fp"].to_numpy(np.int64).view(np.uint64))
        roots = local_roots(points, max_distance)
        moved = roots != np.arange(len(points))
        return pd.DataFrame({"u": points[moved].view(np.int64), "v": points[roots[moved]].view(np.int64)})

    return (reps.select("fp").mapInArrow(shards, "shard long, fp long")
            .groupBy("shard").applyInPandas(search, "u long, v long"))


def _nodes(edges: DataFrame) -> DataFrame:
    """(u, m, loose) of every node: the smallest of itself and its neighbours, and whether it does not just hang on one root or is one."""
    ends = (edges.select("u", "v", F.lit(1).alias("above"), F.lit(0).alias("below"))
            .union(edges.select("v", "u", F.lit(0), F.lit(1))))
    above, below = F.sum("above"), F.max("below")
    return ends.groupBy("u").agg(F.min("v").alias("m"), ((above > 1) | ((above > 0) & (below > 0))).alias("loose")).select(
        "u", F.least("u", "m").alias("m"), "loose")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): alternating large and small stars until every node hangs on one root that hangs on nothing.

    Each round is written, so a lost executor costs no earlier round. A hub's
    smallest neighbour is pre-aggregated and written as well: the join to its
    edges is then one of two plain shuffles, which the adaptive join can split
    (above an aggregate it does not), or a broadcast without any.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not (nodes := written(_nodes(edges))).where("loose").isEmpty():
        least = nodes.select("u", "m")
        large = written(edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .union(least.where("u <> m")).distinct())
        least = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(small.union(least).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, component_id, keeper_key): of each fingerprint the smallest id its component holds."""
    reps = written(prints.groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("first"),
                                            F.min("doc_id").alias("least_id")))
    roots = written(components(links(reps, max_distance)))
    held = reps.join(roots, reps["fp"] == roots["node"], "left").select(
        "fp", "first", "least_id", F.coalesce("root", "fp").alias("root"))
    whole = held.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("first").alias("first"))
    return written(held.select("fp", "root").join(whole, "root").select(
        "fp", "component_id", F.col("first.doc_id").alias("keeper_id"), F.col("first.text_key").alias("keeper_key")))


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, text: str = "text",
                    doc_id: str = "doc_id", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each document."""
    prints = written(fingerprints(docs, text, doc_id, k))
    return prints.join(classes(prints, max_distance), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_copies(docs: DataFrame, max_distance: int = MAX_DISTANCE, text: str = "text",
                doc_id: str = "doc_id") -> DataFrame:
    """The documents without near copies: the one of the smallest id (then text hash) of each class stays."""
    prints = written(fingerprints(docs, text, doc_id))
    stay = classes(prints, max_distance).select("keeper_id", "keeper_key").distinct()
    return one_row_each(docs, prints, stay, text, doc_id)


def one_row_each(docs: DataFrame, prints: DataFrame, stay: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One row of ``docs`` for each (keeper_id, keeper_key) of ``stay``; only repeated keepers are shuffled."""
    rows = prints.groupBy("doc_id", "text_key").count()
    stay = written(stay.join(rows, F.col("keeper_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper_key") == F.col("text_key")))
                   .select("keeper_id", "keeper_key", "count"))

    def of(keepers):
        return docs.join(keepers, docs[f"`{doc_id}`"].eqNullSafe(keepers["keeper_id"])
                         & (F.xxhash64(docs[f"`{text}`"]) == keepers["keeper_key"]), "left_semi")

    many = stay.where("count > 1")
    return of(stay) if many.isEmpty() else of(stay.where("count = 1")).union(of(many).dropDuplicates([doc_id, text]))
