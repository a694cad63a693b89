"""Near-duplicates by MinHash: a multi-index Hamming join of b-bit signatures, links confirmed on whole sets.

A document's set holds its distinct shingles of three words. Its signature has
``CHUNKS`` chunks of ``WIDTH`` symbols, each the low 16 bits of the smallest
value that one hash function takes on the set. Sets of similarity s differ in a
symbol with probability 1 - s. The distance of two signatures is the number of
symbols that differ; pairs beyond ``FARTHEST`` are not looked at. For s = 0.85
a pair is farther apart with a probability of 3e-7; that is the only loss.

* Pigeonhole: if two chunks at most had an error or none, the 15 others had two
  each, 30 in all, and one more leaves room for no third. So within
  ``FARTHEST`` = 31 at least two of the 17 chunks hold one error at most. A
  chunk's keys are its symbols without each one in turn: they meet for every
  pair with one error there. The join of equal keys finds all pairs in reach.
* A key of at most ``SMALL`` sets compares its signatures directly.
* In a larger one every set first meets the key's hub, the set that has most in
  common with others; what is linked becomes a component, so n copies of a text
  cost n comparisons. Sets of large keys that are still apart meet by their
  rarest shingles (``setpairs.sharing_rare``), of which similar sets must share
  one: sets with no more in common than a passage, or than the text they are
  all edited from, do not meet, and sets of one component need not.
* Pairs are confirmed on the whole sets (``setpairs``), and links are
  joined into components by alternating stars. Equal sets are one class from
  the start; links between different texts of a component are implied by it.

Defined results: a null or wordless text has an empty set and is linked with
nothing; fewer than three words are one shingle. Rows with the same id and text
are linked like any others. Null ids take part; a class of nothing else has a
null id and is kept. Shingles and sets are told apart by 64-bit hashes. Texts
of any length are read whole, in blocks. An empty table gives none. Extra
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import written

from . import setpairs
from .common import text_key, texts_in
from .setpairs import SEED, bodies, set_id, text_set
from .simhash import components, one_row_each

SHINGLE = 3
PERCENT = 85
CHUNKS, WIDTH = 17, 5
FARTHEST = 2 * (CHUNKS - 1) - 1
#: Sets of a key that are compared with each other at once.
SMALL = 64
BLOCK = 2048

_RNG = np.random.default_rng(SEED)
_FLIP, _TIMES, _AGAIN = (_RNG.integers(0, 1 << 32, CHUNKS * WIDTH, dtype=np.uint32) | np.uint32(i > 0) for i in range(3))


def signature(own: np.ndarray) -> np.ndarray:
    """The symbols of a set of 64-bit hashes."""
    least = np.full(CHUNKS * WIDTH, 0xFFFFFFFF, np.uint32)
    low = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(low), BLOCK):
        h = (low[at:at + BLOCK, None] ^ _FLIP) * _TIMES
        h ^= h >> np.uint32(16)
        h *= _AGAIN
        np.minimum(least, h.min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def chunk_keys(symbols: np.ndarray, chunk: int) -> np.ndarray:
    """(sets, WIDTH) keys of one chunk: its symbols without each one in turn."""
    own = symbols[:, chunk * WIDTH:(chunk + 1) * WIDTH].astype(np.uint64)
    out = np.empty((len(own), WIDTH), np.uint64)
    for gone in range(WIDTH):
        key = np.full(len(own), 1 + chunk * WIDTH + gone, np.uint64)
        for j in range(WIDTH):
            if j != gone:
                key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + own[:, j] + np.uint64(1)
        out[:, gone] = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out


def _symbols(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), CHUNKS * WIDTH)


def prints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, sid, n, sig) of every document: its set's hash, size and signature."""
    rows = docs.select(*text_key(docs, text, doc_id), docs[f"`{text}`"].cast("binary").alias("__text"))

    def run(batches):
        for b in batches:
            own = [text_set(t, k) for t in texts_in(b)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.array([set_id(s) for s in own], np.uint64).view(np.int64)),
                 pa.array([len(s) for s in own], pa.int64()), pa.array([signature(s).tobytes() for s in own], pa.binary())],
                ["doc_id", "text_key", "sid", "n", "sig"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key long, sid long, n long, sig binary")


def keyed(reps: DataFrame) -> DataFrame:
    """(key, sid) for every chunk and symbol left out."""
    def run(batches):
        for b in batches:
            sig, sid = _symbols(b.column(1)), b.column(0).to_numpy()
            for at in range(0, len(sid), BLOCK):
                keys = np.concatenate([chunk_keys(sig[at:at + BLOCK], c) for c in range(CHUNKS - 1)], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(sid[at:at + BLOCK], keys.shape[1]))], ["key", "sid"])

    return reps.select("sid", "sig").mapInArrow(run, "key long, sid long")


def _close(nu, nv, su, sv, percent: int) -> np.ndarray:
    """Which pairs' sizes and signatures leave them in reach."""
    fits = np.minimum(nu, nv) * 100 >= np.maximum(nu, nv) * percent
    fits[fits] = np.count_nonzero(su[fits] != sv[fits], axis=1) <= FARTHEST
    return fits


def _pair_batch(u, v) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def pairs_within(members: DataFrame, percent: int) -> DataFrame:
    """(u, v) of the pairs in reach among the few ``members`` (key, sid, n, sig) of each key."""
    def run(batches):
        rest = None
        for b in batches:
            b = pa.Table.from_batches([b.select(["key", "sid", "n", "sig"])])
            table = pa.concat_tables([rest, b]) if rest is not None else b
            key = table.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1]))
            rest = table.slice(last)
            yield from compared(table.slice(0, last))
        if rest is not None:
            yield from compared(rest)

    def compared(table):
        key, sid, n = (table.column(i).to_numpy() for i in range(3))
        if not len(key):
            return
        sig, place = _symbols(table.column(3)), np.arange(len(key))
        for step in range(1, SMALL):
            here = place[:-step][key[step:] == key[:-step]]
            if not len(here):
                break
            here = here[_close(n[here], n[here + step], sig[here], sig[here + step], percent)]
            yield _pair_batch(sid[here], sid[here + step])

    return (members.select("key", "sid", "n", "sig").repartition("key").sortWithinPartitions("key", "sid")
            .mapInArrow(run, "u long, v long").distinct())


def stars(members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(u, v) of every member (key, sid, n, sig) in reach of its key's hub, with that hub."""
    def run(batches):
        for b in batches:
            u, nu, v, nv = (b.column(i).to_numpy() for i in (0, 1, 3, 4))
            fits = _close(nu, nv, _symbols(b.column(2)), _symbols(b.column(5)), percent)
            yield _pair_batch(u[fits], v[fits])

    joined = members.join(hubs, "key").where(F.col("sid") != F.col("hub.sid"))
    return joined.select("sid", "n", "sig", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("sid", "n", "sig")]).mapInArrow(run, "u long, v long")


def links(reps: DataFrame, texts_of, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """(u, v), u > v: links that span the components of the sets of ``reps`` (sid, n, sig); ``texts_of(sids)`` gives (sid, body)."""
    alive = keyed(reps).groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = written(keyed(reps).join(alive, "key"))
    weights = members.groupBy("sid").agg(F.sum("size").alias("weight"))
    facts = written(reps.join(weights, "sid").select("sid", "n", "sig", "weight"))
    texts = written(texts_of(facts.select("sid")))
    few = members.where(F.col("size") <= SMALL).select("key", "sid").join(facts, "sid")
    tried = pairs_within(few, percent)
    many = members.where(F.col("size") > SMALL)
    if many.isEmpty():
        return setpairs.confirmed(written(tried), texts, percent, k)
    many = many.select("key", "sid").join(facts, "sid")
    # The whole row of a hub joins later; only ids are compared here.
    hubs = many.groupBy("key").agg(F.max(F.struct("weight", "sid")).alias("m")).select("key", F.col("m.sid").alias("sid"))
    hubs = hubs.join(facts, "sid").select("key", F.struct("sid", "n", "sig").alias("hub"))
    tried = written(tried.union(stars(many, hubs, percent)).distinct())
    near = setpairs.confirmed(tried, texts, percent, k)
    roots = written(components(near)).withColumnRenamed("node", "sid")
    held = written(many.select("sid", "n").distinct().join(roots, "sid", "left").select("sid", "n", F.coalesce("root", "sid").alias("root")))
    more = setpairs.sharing_rare(held, texts, percent, k).join(tried, ["u", "v"], "left_anti")
    return near.union(setpairs.confirmed(written(more), texts, percent, k))


def rooted(docs: DataFrame, percent: int, text: str, doc_id: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The prints of every document, and (sid, first, least_id, root) of every set that has words."""
    every = written(prints(docs, text, doc_id, k))
    reps = written(every.where("n > 0").groupBy("sid").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.min("doc_id").alias("least_id"),
        F.first("n").alias("n"), F.first("sig").alias("sig")))
    found = links(reps, lambda sids: bodies(docs, reps.join(sids, "sid", "left_semi"), text, doc_id), percent, k)
    roots = written(components(found))
    return every, reps.join(roots, reps["sid"] == roots["node"], "left").select(
        "sid", "first", "least_id", F.coalesce("root", "sid").alias("root"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each document."""
    every, held = rooted(docs, percent, text, doc_id, k)
    least = held.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_set = written(held.select("sid", "root").join(least, "root").select("sid", "component_id"))
    whole = every.where("n > 0").join(of_set, "sid").select("doc_id", "n", "component_id")
    return whole.union(every.where("n = 0").select("doc_id", "n", "doc_id")).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_copies(docs: DataFrame, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE) -> DataFrame:
    """The documents without near copies: of each component one row of the smallest id (then text hash) stays.

    Of documents without words, rows that repeat id and text leave one (any, if other columns differ).
    """
    every, held = rooted(docs, percent, text, doc_id, k)
    stay = held.groupBy("root").agg(F.min("first").alias("first")).select("first.*").union(
        every.where("n = 0").select("doc_id", "text_key").distinct())
    stay = stay.select(F.col("doc_id").alias("keeper_id"), F.col("text_key").alias("keeper_key"))
    return one_row_each(docs, every, stay, text, doc_id)
