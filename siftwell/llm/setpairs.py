"""Shingle sets of texts, and pairs of them compared on the whole sets.

Pairs travel as ids. Texts move instead of sets (they compress, hashes do not)
and only those of ids that stand in a pair: one text of each pair goes to the
other's place, which makes both sets again, counts what they share and sends
back the pairs that are similar enough. An id in many pairs is the place of
them all; its pairs are dealt over several tasks of ``PAIRS_EACH`` at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.session import written

SEED = 42
PAIRS_EACH = 256
#: Words whose hashes a task remembers.
WORDS_HELD = 1 << 19
#: Of the counts that tell rare values from common ones: 2 ** 20, whatever the input.
CELL_BITS = 20
#: Of the counts that a task hands on in one row.
BLOCK_BITS = 14
#: Sizes whose ratio is smaller than this are looked at together.
BAND = 1.04


class _WordHashes(dict):
    """XXH64 of words, remembered while few."""

    def __missing__(self, word):
        if len(self) >= WORDS_HELD:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found


_HASHES = _WordHashes()


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """The distinct hashes of a text's shingles of k words, sorted; fewer words are one shingle."""
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    each = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    found = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        found = (found ^ (found >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + each[i:len(words) - k + 1 + i]
    found = (found ^ (found >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(found ^ (found >> np.uint64(31)))


def text_set(text: bytes | None, k: int) -> np.ndarray:
    return shingles(text.lower().split() if text else [], k)


def set_id(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets have in common."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    return int(np.count_nonzero(y[at] == x))


def _cells(own: np.ndarray, bits: int) -> np.ndarray:
    return (own >> np.uint64(64 - bits)).view(np.int64)


def bodies(docs: DataFrame, reps: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(sid, body): one text of each set of ``reps`` (sid, first: its row's id and text hash)."""
    rows = docs.select(docs[f"`{doc_id}`"].alias("d"), F.xxhash64(docs[f"`{text}`"]).alias("key"), docs[f"`{text}`"].cast("binary").alias("body"))
    wanted = reps.select("sid", F.col("first.doc_id").alias("w"), F.col("first.text_key").alias("text_key"))
    return rows.join(wanted, (F.col("key") == F.col("text_key")) & F.col("d").eqNullSafe(F.col("w"))).select("sid", "body").dropDuplicates(["sid"])


def _met(aimed: DataFrame, texts: DataFrame, use, schema: str) -> DataFrame:
    """``use(place, its set, sid, the partner's set)`` for every (place, sid) of ``aimed``, as rows of ``schema``."""
    parts = written(aimed.groupBy("place").count().select("place", F.ceil(F.col("count") / PAIRS_EACH).alias("parts")))
    dealt = aimed.join(parts, "place").select("place", F.pmod(F.xxhash64("sid"), F.col("parts")).alias("part"), "sid")
    there = parts.select("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    own = texts.withColumnsRenamed({"sid": "place"}).join(there, "place").select("place", "part", F.lit(None).cast("long").alias("sid"), "body")
    sent = texts.join(dealt, "sid").select("place", "part", "sid", "body")
    k, run_one = use

    def run(batches):
        place, mine = None, None
        for b in batches:
            for p, sid, body in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                held = text_set(body.as_py(), k)
                if sid is None:
                    place, mine = p, held
                elif p == place:
                    found = run_one(p, mine, sid, held)
                    if found is not None:
                        yield found
                else:
                    raise RuntimeError("a pair came without the text of its place")

    return (own.union(sent).repartition("place", "part").sortWithinPartitions("place", "part", F.col("sid").asc_nulls_first())
            .mapInArrow(run, schema))


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, k: int) -> DataFrame:
    """The (u, v), u > v, of distinct ``pairs`` whose sets have a Jaccard similarity of ``percent`` hundredths or more."""
    degree = written(pairs.select(F.explode(F.array("u", "v")).alias("sid")).groupBy("sid").count())
    aimed = (pairs.join(degree.withColumnsRenamed({"sid": "u", "count": "of_u"}), "u")
             .join(degree.withColumnsRenamed({"sid": "v", "count": "of_v"}), "v"))
    swap = F.col("of_u") > F.col("of_v")
    aimed = written(aimed.select(F.when(swap, F.col("u")).otherwise(F.col("v")).alias("place"),
                                 F.when(swap, F.col("v")).otherwise(F.col("u")).alias("sid")))

    def similar(place, mine, sid, held):
        if shared(mine, held) * (100 + percent) >= (len(mine) + len(held)) * percent:
            return pa.RecordBatch.from_arrays([pa.array([max(place, sid)]), pa.array([min(place, sid)])], ["u", "v"])

    return written(_met(aimed, texts, (k, similar), "u long, v long"))


def _blocks(counts: np.ndarray):
    """A table of counts as rows (block, at, sets) of its blocks, without the counts of zero."""
    for block, start in enumerate(range(0, len(counts), 1 << BLOCK_BITS)):
        own = counts[start:start + (1 << BLOCK_BITS)]
        at = np.flatnonzero(own)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([own[at].tobytes()])],
                                             ["block", "at", "sets"])


def _add(counts: np.ndarray, rows) -> None:
    """Adds rows (block, at, sets) to a table of counts."""
    for block, at, sets in zip(*(rows.column(c).to_pylist() for c in ("block", "at", "sets"))):
        counts[(block << BLOCK_BITS) + np.frombuffer(at, np.uint16).astype(np.int64)] += np.frombuffer(sets, np.int64)


COUNTS = "block int, at binary, sets binary"


def task_counts(held: DataFrame, k: int, bits: int = CELL_BITS) -> DataFrame:
    """How many values of the sets of ``held`` (body) fall into each of 2 ** ``bits`` cells, by task.

    The counts leave a task as blocks of its table: a row for each block at most, however many values it has read.
    """
    def counted(batches):
        counts = np.zeros(1 << bits, np.int64)
        for b in batches:
            for body in b.column(0):
                np.add.at(counts, _cells(text_set(body.as_py(), k), bits), 1)
        yield from _blocks(counts)

    return held.select("body").mapInArrow(counted, COUNTS)


def cell_counts(held: DataFrame, k: int, bits: int = CELL_BITS) -> np.ndarray:
    """The counts of all tasks, summed block by block."""
    def summed(batches):
        counts = np.zeros(1 << bits, np.int64)
        for b in batches:
            _add(counts, b)
        yield from _blocks(counts)

    counts = np.zeros(1 << bits, np.int64)
    _add(counts, task_counts(held, k, bits).repartition("block").mapInArrow(summed, COUNTS).toArrow())
    return counts


def _band(size: Column) -> Column:
    return F.floor(F.log(size) / F.log(F.lit(BAND)))


def sides(first: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The smaller and the larger sets that may meet, of ``first`` (token, sid, n, root, left, other): by token, kind and band of the smaller one's size.

    ``most`` is the sum of two sizes that a set's ``left`` allows for, so ``most - n`` is its largest partner. A larger set looks for
    partners from n percent / 100 up to that only. Of many sets of one size, those with few values left meet nothing.
    """
    most = F.expr(f"`left` * {100 + percent} div {percent}")
    first = first.withColumn("most", most)
    # The smaller of two similar sets has at least 2 n percent / (100 + percent) left.
    x = first.where(F.col("most") >= 2 * F.col("n")).withColumn("band", _band(F.col("n"))).withColumn(
        "meets", F.explode(F.when(F.col("other"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    least, largest = F.expr(f"(n * {percent} + 99) div 100"), F.least("n", F.col("most") - F.col("n"))
    y = first.where(largest >= least).withColumn("band", F.explode(F.sequence(_band(least), _band(largest)))).withColumnRenamed("other", "meets")
    return x, y


def sharing_rare(sets: DataFrame, texts: DataFrame, percent: int, k: int, bits: int = CELL_BITS) -> DataFrame:
    """(u, v), u > v: all pairs of ``sets`` (sid, n, root) with different roots that can be similar enough.

    Values are in one order for all sets, the rarest first; ``left`` is how many
    of a set's values stand from one on, without those that surely no other set
    has (they come first and are not kept). Similar sets x and y share at least
    (n(x) + n(y)) percent / (100 + percent) values, so at the first one they
    share both have as many left, and at least n percent / 100. That holds for
    any order: this one keeps values that many sets share out of what meets.
    How rare a value is says a table of 2 ** ``bits`` counts, some of them shared, so
    each text's task knows the order and only its first values leave it. Of a
    value's sets those of its commonest root meet the others only, and of any
    two the smaller set has the value among the few that leave room for both
    and a size in one of the few bands that the larger one has room for.
    """
    held = sets.join(texts, "sid").select("sid", "n", "root", "body")
    sent = held.sparkSession.sparkContext.broadcast(cell_counts(held, k, bits))

    def foremost(batches):
        for b in batches:
            for sid, n, root, body in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
                own = text_set(body.as_py(), k)
                shared_by = sent.value[_cells(own, bits)]
                own, shared_by = own[shared_by > 1], shared_by[shared_by > 1]
                left = np.arange(len(own), 0, -1)
                own, left = (x[left * 100 >= n * percent] for x in (own[np.lexsort((own, shared_by))], left))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.view(np.int64)), *(pa.array(np.full(len(own), x)) for x in (sid, n, root)), pa.array(left)],
                    ["token", "sid", "n", "root", "left"])

    first = written(held.mapInArrow(foremost, "token long, sid long, n long, root long, left long"))
    common = first.groupBy("token", "root").count().groupBy("token").agg(
        F.max(F.struct("count", "root"))["root"].alias("common"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    first = written(first.join(common.select("token", "common"), "token").withColumn("other", F.col("root") != F.col("common")))
    x, y = (side.alias(name) for side, name in zip(sides(first, percent), "xy"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.meets") == F.col("y.meets")) & (F.col("x.band") == F.col("y.band"))
                 & (F.col("x.root") != F.col("y.root")) & (F.struct("x.n", "x.sid") < F.struct("y.n", "y.sid"))
                 & (F.least("x.most", "y.most") >= F.col("x.n") + F.col("y.n")))
    return met.select(F.greatest("x.sid", "y.sid").alias("u"), F.least("x.sid", "y.sid").alias("v")).distinct()
