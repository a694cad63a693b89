"""Benchmark decontamination by suffix arrays over the training text.

Each task cuts its documents into shards of a bounded number of words and
builds a suffix array of each shard, over words as numbers of the benchmark's
vocabulary. Runs of benchmark words too short to hold any benchmark window
cannot match and are left out of the array, which keeps it small whatever the
shard holds. Every suffix of every test item is then binary-searched, all of
them at once; the ranges found give the places of each window, and windows
that follow each other in both texts grow into longest verbatim matches.

The benchmark is the query set: it is cut into blocks of ``BLOCK_BYTES`` of
text, and each block in turn is sent to all tasks, so what is broadcast has a
bound at any size of the benchmark. Documents are never shuffled.

Words are lower-cased (A-Z only) runs of digits, letters and characters beyond
ASCII. A window is ``WINDOW`` words of an item, or a shorter item as a whole.

Defined results: a null or empty text has no words and is clean. Items without
words match nothing; a null item id counts as an item named "null"; items of
one id are one item. An empty benchmark leaves every document clean. Rows are
judged one by one and extra columns handed through, whatever their names.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, texts_in, unpacked, with_results

WINDOW = 10
SHARD_WORDS = 1 << 21
BLOCK_BYTES = 32 << 20
MATCH = "struct<start:int,length:int,item_id:string,item_start:int>"

_WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class TestSet:
    """The suffixes of a block of items: the vocabulary, and the distinct windows as rows of numbers."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple, list] = {}
        self.names: list[str] = []
        for name, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words(text)]
            size = min(window, len(words))
            for at in range(len(words) - size + 1 if size else 0):
                found.setdefault(tuple(words[at:at + size]), []).append((len(self.names), at))
            self.names.append(name)
        self.sizes = np.array([len(w) for w in found], np.int64)
        self.rows = np.zeros((len(found), window), np.int64)
        for i, w in enumerate(found):
            self.rows[i, :len(w)] = w
        self.shortest = int(self.sizes.min()) if found else 0
        ends = np.cumsum([0, *(len(v) for v in found.values())])
        self.first, self.last = ends[:-1], ends[1:]
        places = [p for v in found.values() for p in v]
        self.item, self.at = (np.array([p[k] for p in places], np.int64) for k in (0, 1))


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``words`` in the order of their suffixes, compared over at least ``depth`` words."""
    rank, reach = words.astype(np.int64), 1
    while True:
        ahead = np.zeros_like(rank)
        ahead[:-reach or None] = rank[reach:] + 1
        key = rank * (int(ahead.max(initial=0)) + 1) + ahead
        order = np.argsort(key, kind="stable")
        step = np.diff(key[order], prepend=key[order[:1]]) != 0
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(step)
        reach *= 2
        if reach >= depth or (len(rank) and rank[order[-1]] == len(rank) - 1):
            return order


def _bound(words: np.ndarray, order: np.ndarray, tests, upper: bool) -> np.ndarray:
    """Where each window would be put among the sorted suffixes, before or after those it starts."""
    low, high = np.zeros(len(tests.sizes), np.int64), np.full(len(tests.sizes), len(order))
    columns = np.arange(tests.window)
    inside = columns < tests.sizes[:, None]
    for _ in range(int(len(order)).bit_length()):
        busy = np.flatnonzero(low < high)
        if not len(busy):
            break
        middle = (low[busy] + high[busy]) // 2
        seen = words[order[middle][:, None] + columns]
        differ = (seen != tests.rows[busy]) & inside[busy]
        at = differ.argmax(axis=1)
        pick = np.arange(len(busy))
        some = differ[pick, at]
        less = np.where(some, seen[pick, at] < tests.rows[busy, at], upper)
        low[busy] = np.where(less, middle + 1, low[busy])
        high[busy] = np.where(less, high[busy], middle)
    return low


def search(shard: np.ndarray, tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, item, item start) of the longest matches; ``shard`` holds word numbers, 0 for any other."""
    none = (np.zeros(0, np.int64),) * 4
    if not tests.shortest or not len(shard):
        return none
    gaps = np.flatnonzero(np.concatenate([[True], shard == 0, [True]])) - 1
    runs = np.diff(gaps) - 1
    long = runs >= tests.shortest
    mark = np.zeros(len(shard) + 1, np.int32)
    np.add.at(mark, gaps[:-1][long] + 1, 1)
    np.add.at(mark, gaps[1:][long] + 1, -1)  # the gap after a run stays, as a border
    kept = np.flatnonzero(np.cumsum(mark[:-1]))
    if not len(kept):
        return none
    words = np.concatenate([shard[kept], np.zeros(tests.window, shard.dtype)])
    order = suffix_array(words[:len(kept)], tests.window)
    low, high = _bound(words, order, tests, False), _bound(words, order, tests, True)
    window = np.repeat(np.arange(len(low)), high - low)
    if not len(window):
        return none
    inner = np.arange(len(window)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
    start = kept[order[low[window] + inner]]
    # Each place of a window, for each item that has it.
    uses = tests.last[window] - tests.first[window]
    which = np.repeat(np.arange(len(window)), uses)
    use = tests.first[window][which] + np.arange(len(which)) - np.repeat(np.cumsum(uses) - uses, uses)
    start, size, item, at = start[which], tests.sizes[window][which], tests.item[use], tests.at[use]
    order = np.lexsort((start, start - at, item))
    start, size, item, at = start[order], size[order], item[order], at[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (item[1:] != item[:-1]) | (start[1:] != start[:-1] + 1) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(start)) - 1
    return start[head], start[tail] + size[tail] - start[head], item[head], at[head]


def _shards(batch: pa.RecordBatch, vocabulary: dict, most: int):
    """(rows, word numbers of them with a 0 after each, sizes), of bounded length but for a single longer text."""
    rows, numbers, sizes = [], [], []
    get = vocabulary.get
    for i, text in enumerate(texts_in(batch)):
        words = split_words(text)
        rows.append(i)
        sizes.append(len(words))
        numbers.extend([get(w, 0) for w in words])
        numbers.append(0)
        if len(numbers) >= most:
            yield rows, np.array(numbers, np.int64), sizes
            rows, numbers, sizes = [], [], []
    if rows:
        yield rows, np.array(numbers, np.int64), sizes


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int, window: int):
    """The test items, a bounded block at a time."""
    items = benchmark.select(F.coalesce(benchmark[f"`{item_id}`"].cast("string"), F.lit("null")).alias("name"),
                             benchmark[f"`{text}`"].cast("binary").alias("text"))
    total = items.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + F.length("name"))).first()[0] or 0
    count = total // block_bytes + 1
    for n in range(count):
        rows = items.where(F.pmod(F.xxhash64("name", "text"), F.lit(count)) == n).toLocalIterator()
        yield TestSet([(r["name"], bytes(r["text"] or b"")) for r in rows], window)


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS,
         block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """(__row, n_words, matches): each document (or its columns ``carry``) as a struct, with its longest matches.

    A match is (start, length, item_id, item_start), in words.
    """
    rows = packed(docs, text, carry).withColumns({"n_words": F.lit(0).cast("long"),
                                           "matches": F.array().cast(f"array<{MATCH}>")})
    schema = T.StructType([rows.schema["__row"], rows.schema["__text"], T.StructField("n_words", T.LongType()),
                           T.StructField("matches", T._parse_datatype_string(f"array<{MATCH}>"))])
    for tests in _blocks(benchmark, item_id, item_text, block_bytes, window):
        rows = rows.mapInArrow(_task(docs.sparkSession.sparkContext.broadcast(vars(tests)), shard_words), schema)
    return rows.select("__row", "n_words", "matches")


def _task(sent, shard_words: int):
    def run(batches):
        tests = SimpleNamespace(**sent.value)
        for batch in batches:
            held = batch.column(3).to_pylist()
            counts = np.zeros(batch.num_rows, np.int64)
            for rows, numbers, sizes in _shards(batch, tests.vocabulary, shard_words):
                ends = np.cumsum(np.array(sizes) + 1)
                counts[rows] = sizes
                starts, lengths, items, at = search(numbers, tests)
                for i, s, n, item, a in zip(np.searchsorted(ends, starts, "right"), starts, lengths, items, at):
                    base = ends[i] - sizes[i] - 1
                    held[rows[i]] = held[rows[i]] + [{"start": int(s - base), "length": int(n),
                                                      "item_id": tests.names[item], "item_start": int(a)}]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts), pa.array(held, batch.schema.field(3).type)],
                names=batch.schema.names)
    return run


def hit_words(matches: Column) -> Column:
    """How many words of the document stand in a match: matches may overlap."""
    ordered = F.array_sort(matches)
    return F.aggregate(
        ordered, F.struct(F.lit(0).alias("reach"), F.lit(0).cast("long").alias("n")),
        lambda a, m: F.struct(F.greatest(a["reach"], m["start"] + m["length"]).alias("reach"),
                              (a["n"] + F.greatest(F.lit(0), m["start"] + m["length"]
                                                   - F.greatest(a["reach"], m["start"]))).alias("n")),
        lambda a: a["n"])


def item_ids(matches: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["item_id"])))


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, start, length, item_id, item_start), one row for each longest match."""
    return (scan(docs, benchmark, carry=[doc_id], **options).select(F.col(f"__row.`{doc_id}`").alias("doc_id"), F.explode("matches").alias("m"))
            .select("doc_id", "m.*"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    return unpacked(scan(docs, benchmark, **options).where(F.size("matches") == 0), docs.columns)
