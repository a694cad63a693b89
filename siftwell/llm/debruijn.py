"""Repeated spans, found in a compacted de Bruijn graph of the corpus.

Token k-mers are the graph's edges. Only the k-mers that are the least (by
hash) of some window of ``WINDOW`` words are kept as anchors, about one word in
twelve, and the windows that share an anchor form one path: an edge of the
compacted graph, given by its anchor and a hash of all its words. Equal windows
have equal anchors at equal offsets, so they can only meet under one anchor.

* Spark counts the anchors; those that occur once end every path through them.
* Under a repeated anchor, paths that are equal as a whole compact to one class
  by a join on (anchor, path): all windows of a class of two or more repeat.
* Only where classes branch, one path of each class is opened into its windows
  at its source coordinates, and windows found in two classes repeat as well.

A window is taken as repeated when its anchor and its own hash agree, two
64-bit values worked out from the words at the source coordinates.

Rows per anchor are only counted and joined, never gathered, and counts are
summed before they are shuffled; joins are between written tables, so Spark
splits a hot anchor. The texts are shuffled once, to meet their paths.

Defined results: null is a text without words. A text shorter than a window
repeats nothing. Rows with the same id and text are two documents, each the
copy of the other. Null ids are ids. Extra columns are handed through by
``remove_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import written

from .common import text_key, texts_in, words_of

WINDOW = 35
K = 12
CHUNK_WORDS = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Word hashes; forgotten when there are many."""

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two, in order."""
    x = a * _A + (b ^ (b >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words, built from runs of doubled length."""
    if len(words) < size:
        return words[:0]
    whole, done, power, length = None, 0, words, 1
    while True:
        if size & length:
            part = power[done:len(words) - size + done + 1]
            whole = part if whole is None else _pair(whole, part)
            done += length
        if done == size:
            return whole
        power = _pair(power[:len(power) - length], power[length:])
        length *= 2


def least_places(values: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` values, the place of its first least one."""
    at, length = np.arange(len(values)), 1
    while length < size:
        step = min(length, size - length)
        a, b = at[:len(at) - step], at[step:]
        at = np.where(values[a] <= values[b], a, b)
        length += step
    return at


def paths(hashes: np.ndarray, window: int = WINDOW, k: int = K):
    """(anchor, first window, number of windows, path hash, window hashes) over one text's word hashes."""
    own = window_hashes(hashes, window)
    kmers = window_hashes(hashes, k)
    if not len(own):
        empty = np.zeros(0, np.int64)
        return own, empty, empty, own, own
    anchors = least_places(kmers, window - k + 1)
    first = np.flatnonzero(np.diff(anchors, prepend=-1))
    count = np.diff(np.append(first, len(anchors)))
    whole = _pair(own[first], own[first + count - 1]) + count.astype(np.uint64)
    return kmers[anchors[first]], first, count, whole, own


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _listed(parts: list[np.ndarray], kind=np.int64) -> pa.Array:
    offsets = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
    joined = np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(joined.astype(kind, copy=False)))


def edges(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, text_key, n_words, words_sha256, anchors, starts, sizes, wholes): each text's compacted paths."""
    rows = docs.select(*text_key(docs, text, doc_id), docs[f"`{text}`"].cast("binary").alias("__text"))

    def run(batches):
        known = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, shas, found = [], [], []
                for t in texts_in(part):
                    words = words_of(t)
                    counts.append(len(words))
                    shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    found.append(paths(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), window, k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
                     _listed([f[0].view(np.int64) for f in found]), _listed([f[1] for f in found], np.int32),
                     _listed([f[2] for f in found], np.int32), _listed([f[3].view(np.int64) for f in found])],
                    ["doc_id", "text_key", "n_words", "words_sha256", "anchors", "starts", "sizes", "wholes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, n_words long, words_sha256 string, anchors array<long>, "
                                "starts array<int>, sizes array<int>, wholes array<long>")


def _repeated_paths(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, size, anchor, state) of the paths under repeated anchors.

    ``state``: 2, all windows repeat; 1, all repeat and the windows are to be
    opened for others; 0, the only path of its class, to be opened for itself.
    """
    each = found.select("doc_id", "text_key", F.explode(F.arrays_zip("anchors", "starts", "sizes", "wholes")).alias("e")).select(
        "doc_id", "text_key", F.col("e.anchors").alias("anchor"), F.col("e.starts").alias("start"),
        F.col("e.sizes").alias("size"), F.col("e.wholes").alias("whole"))
    again = written(each.groupBy("anchor").agg(F.count("*").alias("n"), (F.min("whole") != F.max("whole")).alias("branches"))
                    .where("n > 1").select("anchor", "branches"))
    held = written(each.join(again, "anchor"))
    where = F.struct("doc_id", "text_key", "start")
    classes = written(held.where("branches").groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(where).alias("first"))
                      .withColumnsRenamed({"anchor": "a", "whole": "w"}))
    joined = held.join(classes, (F.col("anchor") == F.col("a")) & (F.col("whole") == F.col("w")), "left")
    state = (F.when(~F.col("branches"), 2).when(F.col("n") == 1, 0)
             .when(F.col("first").eqNullSafe(where), 1).otherwise(2))
    return joined.select("doc_id", "text_key", "start", "size", "anchor", state.alias("state"))


def _opened(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str, window: int) -> DataFrame:
    """(doc_id, text_key, __text, full, windows) of the documents with repeated anchors.

    ``full`` lists (start, size) of paths that repeat whole, ``windows`` the
    (anchor, place, hash, own) of the ones to be compared.
    """
    lists = wanted.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "size", "anchor", "state")).alias("p"))
    lists = lists.withColumnsRenamed({"doc_id": "__d", "text_key": "__k"})
    rows = docs.select(*text_key(docs, text, doc_id), docs[f"`{text}`"].cast("binary").alias("__text"))
    rows = rows.join(lists, rows["doc_id"].eqNullSafe(lists["__d"]) & (rows["text_key"] == lists["__k"])).select(
        "doc_id", "text_key", "__text", F.col("p.start").alias("starts"), F.col("p.size").alias("sizes"),
        F.col("p.anchor").alias("anchors"), F.col("p.state").alias("states"))

    def run(batches):
        known = _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [[] for _ in range(6)]
                columns = [part.column(i) for i in range(3, 7)]
                for i, t in enumerate(texts_in(part)):
                    start, size, anchor, state = (np.asarray(c[i].values) for c in columns)
                    full, open_ = state >= 1, state <= 1
                    out[0].append(start[full])
                    out[1].append(size[full])
                    words = words_of(t)
                    own = window_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), window) if open_.any() else None
                    sizes = size[open_]
                    place = np.repeat(start[open_], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    out[2].append(np.repeat(anchor[open_], sizes))
                    out[3].append(place)
                    out[4].append(own[place].view(np.int64) if len(place) else np.zeros(0, np.int64))
                    out[5].append(np.repeat(state[open_] == 0, sizes).astype(np.int32))
                kinds = (np.int32, np.int32, np.int64, np.int32, np.int64, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), *(_listed(o, kind) for o, kind in zip(out, kinds))],
                    ["doc_id", "text_key", "__text", "starts", "sizes", "anchors", "places", "hashes", "own"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, __text binary, starts array<int>, sizes array<int>, "
                                "anchors array<long>, places array<int>, hashes array<long>, own array<int>")


def _cut(held: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_key, n_removed, kept) of the documents with repeated anchors."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                removed, kept = [], []
                for i, t in enumerate(texts_in(part)):
                    start, size, single = (np.asarray(part.column(c)[i].values, np.int64) for c in (3, 4, 5))
                    words = words_of(t)
                    mark = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mark, np.concatenate([start, single]), 1)
                    np.add.at(mark, np.concatenate([start + size, single + 1]) + window - 1, -1)
                    stay = np.cumsum(mark[:-1]) == 0
                    removed.append(len(words) - int(stay.sum()))
                    kept.append(b" ".join([w for w, s in zip(words, stay.tolist()) if s]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "text_key", "n_removed", "kept"])

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(run, f"doc_id {kind}, text_key long, n_removed long, kept binary")


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, k: int = K):
    """(every document's paths, the documents that lose words): the second as (doc_id, text_key, n_removed, kept)."""
    found = written(edges(docs, text, doc_id, window, k))
    opened = written(_opened(docs, _repeated_paths(found), text, doc_id, window))
    each = opened.select("doc_id", "text_key", F.explode(F.arrays_zip("anchors", "places", "hashes", "own")).alias("e")).select(
        "doc_id", "text_key", F.col("e.anchors").alias("anchor"), F.col("e.places").alias("place"),
        F.col("e.hashes").alias("hash"), F.col("e.own").alias("own")).distinct()
    twice = written(each.groupBy("anchor", "hash").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "hash"))
    single = written(each.where("own = 1").join(twice, ["anchor", "hash"])
                     .groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("singles"))
                     .withColumnsRenamed({"doc_id": "__d", "text_key": "__k"}))
    held = opened.dropDuplicates(["doc_id", "text_key"]).join(
        single, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_key") == F.col("__k")), "left").select(
        "doc_id", "text_key", "__text", "starts", "sizes",
        F.coalesce("singles", F.array().cast("array<int>")).alias("singles"))
    return found, written(_cut(held, window).where("n_removed > 0"))


def dedup_digests(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row for each document."""
    found, cut = repeats(docs, text, doc_id, window)
    cut = cut.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), "n_removed",
                     F.sha2("kept", 256).alias("sha"))
    return found.select("doc_id", "text_key", "n_words", "words_sha256").join(
        cut, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_key") == F.col("__k")), "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("sha", "words_sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """The documents; where words repeat, the text is what is left of it, single-spaced."""
    _, cut = repeats(docs, text, doc_id, window)
    cut = cut.select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), F.col("kept").cast("string").alias("__kept"))
    joined = docs.join(cut, docs[f"`{doc_id}`"].eqNullSafe(cut["__d"]) & (F.xxhash64(docs[f"`{text}`"]) == cut["__k"]), "left")
    return joined.select(*[(F.coalesce(cut["__kept"], docs[f"`{c}`"]) if c == text else docs[f"`{c}`"]).alias(c)
                           for c in docs.columns])
