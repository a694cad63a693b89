"""Language-model scores by online logistic context mixing.

A text is a sequence of tokens (its words, then one end). Every token is coded
as a run of binary decisions, and every decision is predicted by several tables
of counts, each addressed by a hash of another context. The predictions, as
log odds, are mixed by weights that a gate picks (how much the longer contexts
have seen), and the mixed odds give the bits that the text costs:

* The ``TREE_WORDS`` most frequent training words, the end and an escape are
  leaves of a Huffman tree. The decisions on the way to a leaf are predicted
  from the node alone, the node with the last frequent word, and the node with
  the word before and the two last frequent words.
* Any other word follows an escape. Its cost mixes its count among the escaped
  training words with its spelling: the bits of its bytes, predicted from the
  last one to four bytes and learned from the distinct escaped training words.

Counts come from all training rows and are summed by Spark. So do the weights a
text starts with: the slopes and curvatures of the cost are summed over every
decision of all training rows (for spelling, of all distinct escaped training
words), and each gate's weights take Newton's step. While a text is scored they
are refined: after every ``SEGMENT`` tokens the text's own errors move its copy.

Scale: tasks cut the texts into blocks, each with a vocabulary of its own, so
what Spark counts and joins is one row for each block and distinct word; the
full vocabulary is nowhere in one place. Blocks meet their words' counts in a
cogroup of bounded size. The context tables have ``SLOTS`` cells each whatever
the input: contexts that fall into one cell share it, none is left out. Among
the tokens (or bytes) at hand, those with the same before them lead to the same
decisions: these are made once and weigh as often as they occur.

Defined results: null is an empty text, which has one token, the end. Rows with
equal ids are scored one by one; a null id is hashed as the text "null". Without
training rows every count is zero and scores are finite. Extra columns are not
read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.session import discard, scratch_path, written

TREE_WORDS = 4095
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
CELLS = 4096
GATES = 64
SEGMENT = 64
BLOCK_TOKENS = 1 << 21
BLOCK_WORDS = 300_000
BLOCK_BYTES = 1 << 26
#: Bytes of text that are cut into words at once.
SLICE_BYTES = 1 << 22
CHUNK_TOKENS = 1 << 17
#: Bytes of rows, and tokens, among which equal decisions are made once.
GATHERED_BYTES, GROUP_TOKENS, PIECE_TOKENS = 1 << 21, 1 << 20, 1 << 16
#: Tokens whose decisions are made at once.
AT_ONCE = 1 << 12
ESCAPE, END = 0, 1
PRIOR = 0.4
#: What damps a step of a text's own weights, and of the weights learned from all.
STIFF, STILL = 60, 50
#: How often all training rows are read to learn the weights.
PASSES = 1
#: The most frequent words that stand for a text's language and kind.
COMMON = 64
#: How many bytes before a byte predict it.
ORDERS = (1, 2, 3, 4)
_MULT, _NODE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(doc_id: Column) -> Column:
    """One row in ten is kept from training, by its id."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), F.lit(10)) == 0


# ------------------------------------------------------- blocks of documents


def _slices(batch: pa.RecordBatch, column: int):
    """Rows in a row whose texts have ``SLICE_BYTES`` at most, or a single longer one."""
    ends, at = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy()), 0
    while at < batch.num_rows:
        most = SLICE_BYTES + (ends[at - 1] if at else 0)
        end = max(at + 1, int(np.searchsorted(ends, most, "right")))
        yield batch.slice(at, end - at)
        at = end


def _flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts in lower case one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string()).fill_null("")))
    words, text = lists.flatten(), pc.list_parent_indices(lists)
    there = pc.greater(pc.binary_length(words), 0)  # white space at a text's ends leaves empty ones
    return words.filter(there), np.bincount(text.filter(there).to_numpy(), minlength=len(texts))


def blocks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(block, doc_id, held_out, tokens, words, trained): the texts as numbers of their block's words.

    A block has a row for each document, whose ``tokens`` are 32-bit places in
    the block's vocabulary, and one row of its ``words`` with their number of
    training tokens.
    """
    rows = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), held_out(docs[f"`{doc_id}`"]).alias("held_out"),
                       F.spark_partition_id().cast("long").alias("part"), docs[f"`{text}`"].cast("binary").alias("__text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        known, trained, seen, number = pa.array([], pa.string()), np.zeros(0, np.int64), 0, 0
        block, id_kind = 0, None

        def made(doc_id, held, tokens, words, trained):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), block)), doc_id, held, tokens, words, trained],
                                              ["block", "doc_id", "held_out", "tokens", "words", "trained"])

        def vocabulary():
            whole = pa.array([0, len(known)], pa.int32())
            return made(pa.nulls(1, id_kind), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()),
                        pa.ListArray.from_arrays(whole, known.view(pa.binary())), pa.ListArray.from_arrays(whole, pa.array(trained)))

        for batch in batches:
            id_kind = batch.schema.field(0).type
            part = batch.column(2)[0].as_py() if batch.num_rows else 0
            for some in _slices(batch, 3):
                block = part << 32 | number
                flat, sizes = _flat_words(some.column(3))
                coded = pa.concat_arrays([known, flat]).dictionary_encode()
                own = coded.indices.to_numpy()[len(known):].astype(np.uint32)
                known = coded.dictionary
                used = own[np.repeat(~some.column(1).to_numpy(zero_copy_only=False), sizes)]
                trained = np.bincount(used, minlength=len(known)) + np.pad(trained, (0, len(known) - len(trained)))
                n, ends = some.num_rows, pa.array(np.concatenate([[0], np.cumsum(4 * sizes)]), pa.int32())
                tokens = pa.Array.from_buffers(pa.binary(), n, [None, ends.buffers()[1], pa.py_buffer(own)])
                yield made(some.column(0), some.column(1), tokens, pa.nulls(n, pa.list_(pa.binary())), pa.nulls(n, pa.list_(pa.int64())))
                seen += len(own) + n
                if seen > BLOCK_TOKENS or len(known) > BLOCK_WORDS or known.nbytes > BLOCK_BYTES:
                    yield vocabulary()
                    known, trained, seen, number = known[:0], trained[:0], 0, number + 1
        if len(known):
            yield vocabulary()

    return rows.mapInArrow(run, f"block long, doc_id {id_type}, held_out boolean, tokens binary, "
                                "words array<binary>, trained array<long>")


# ----------------------------------------------------------------- the tree


def huffman(counts: list[int]) -> SimpleNamespace:
    """The ways to the leaves: for leaf i the nodes and bits from ``start[i]`` on, ``length[i]`` of them."""
    heap = [(c, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    children, order = [], len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children.append((a[2], b[2]))
        heapq.heappush(heap, (a[0] + b[0], order, len(counts) + len(children) - 1))
        order += 1
    ways: dict[int, list] = {len(counts) + len(children) - 1: []}
    for inner in range(len(children) - 1, -1, -1):
        way = ways.pop(len(counts) + inner)
        for bit, child in enumerate(children[inner]):
            ways[child] = [*way, (inner, bit)]
    flat = [step for i in range(len(counts)) for step in ways[i]]
    length = np.array([len(ways[i]) for i in range(len(counts))], np.int64)
    return SimpleNamespace(nodes=np.array([s[0] for s in flat], np.int64), bits=np.array([s[1] for s in flat], np.int8),
                           start=np.cumsum(length) - length, length=length, size=len(children))


def _last(values: np.ndarray, valid: np.ndarray, first: np.ndarray) -> np.ndarray:
    """At each place the last valid value before it in its text, 0 if there is none; ``first`` is each text's start."""
    at = np.where(valid, np.arange(len(values)), -1)
    seen = np.concatenate([[-1], np.maximum.accumulate(at)[:-1]]) if len(at) else at
    return np.where(seen >= first, values[np.maximum(seen, 0)], 0)


def tokens_before(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """For each token of some texts (token ids, tokens a text) the one before it and the two last frequent words."""
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.where(np.arange(len(ids)) > first, np.concatenate([[0], ids[:-1]]), 0) if len(ids) else ids
    common = (ids > END) & (ids < END + COMMON)
    last = _last(ids, common, first)
    return [before, last, _last(last, common, first)]


def tree_steps(ids: np.ndarray, before: list[np.ndarray], tree) -> SimpleNamespace:
    """Every decision of some tokens: its bit, its cells, its token's place."""
    word, last, second = before
    contexts = [(word + 1).astype(np.uint64), (last * COMMON + second + (1 << 40)).astype(np.uint64), (last + (1 << 20)).astype(np.uint64)]
    contexts = [c * _MULT for c in contexts]
    n = tree.length[ids]
    ends = np.cumsum(n)
    offset, spread, total = tree.start[ids] - (ends - n), tree.nodes.astype(np.uint64) * _NODE, int(ends[-1]) if len(ids) else 0
    bit, cells, tokens = np.empty(total, tree.bits.dtype), [np.empty(total, np.int64) for _ in range(4)], np.empty(total, np.int32)
    for at in range(0, len(ids), AT_ONCE):  # few enough to stay in a core's cache
        own = slice(at, at + AT_ONCE)
        some = slice(int(ends[at] - n[at]), int(ends[own][-1]))
        token = np.repeat(np.arange(at, min(at + AT_ONCE, len(ids))), n[own])
        step = offset[token]
        step += np.arange(some.start, some.stop)
        np.take(tree.bits, step, out=bit[some], mode="clip")
        np.take(tree.nodes, step, out=cells[0][some], mode="clip")
        inner = spread[step]
        for c, cell in zip(contexts, cells[1:]):
            _cell(c[token], inner, cell[some])
        tokens[some] = token
    return SimpleNamespace(bit=bit, cells=cells, token=tokens)


def tree_bits(ids: np.ndarray, sizes: np.ndarray, tree, order: np.ndarray | None = None) -> SimpleNamespace:
    """``tree_steps`` of all tokens of some texts (token ids, tokens a text), the tokens taken in ``order``."""
    before = tokens_before(ids, sizes)
    return tree_steps(ids, before, tree) if order is None else tree_steps(ids[order], [x[order] for x in before], tree)


def tree_groups(ids: np.ndarray, sizes: np.ndarray, tree):
    """(bit, cells, times): the decisions of some texts, those of tokens that have the same before them made once."""
    key = ids
    for own, most in zip(tokens_before(ids, sizes), (TREE_WORDS + 2, END + COMMON, END + COMMON)):
        key = key * most + own
    key, times = np.unique(key, return_counts=True)
    before = []
    for most in (END + COMMON, END + COMMON, TREE_WORDS + 2):
        key, own = np.divmod(key, most)
        before.insert(0, own)
    for at in range(0, len(key), PIECE_TOKENS):
        own = slice(at, at + PIECE_TOKENS)
        b = tree_steps(key[own], [x[own] for x in before], tree)
        yield b.bit, b.cells, times[own][b.token]


def _cell(context: np.ndarray, place: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """The cell of a context and a place in it, both spread by odd factors already."""
    x = np.bitwise_xor(context, place, out=None if out is None else out.view(np.uint64))
    x ^= x >> np.uint64(29)
    x *= _MULT
    x >>= np.uint64(64 - SLOT_BITS)
    return x.view(np.int64)


# ------------------------------------------------------------------ spelling


def spelled_bytes(words: list[bytes]) -> np.ndarray:
    """Every byte of the words, a space after each: itself in the lowest eight bits, those before it above, the last one highest."""
    body = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    ends = np.flatnonzero(body == 0x20)
    first = np.zeros(len(body), np.int64)
    first[ends[:-1] + 1] = ends[:-1] + 1
    first = np.maximum.accumulate(first)
    place, x = np.arange(len(body)), np.zeros(len(body), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        past = np.where(place - n >= first, np.concatenate([np.zeros(min(n, len(body)), np.uint8), body[:-n]]), 0)
        x = (x << np.uint64(8)) + past
    return (x << np.uint64(8)) + body


def byte_steps(spelling: np.ndarray):
    """For each of the eight bit places: (bit, four cells) of some bytes as ``spelled_bytes`` gives them."""
    body, past = spelling.astype(np.uint8), spelling >> np.uint64(8)
    contexts = [((past >> np.uint64(8 * (max(ORDERS) - n))) + np.uint64(n << 56)) * _MULT for n in ORDERS]
    partial = np.ones(len(body), np.uint64)
    for k in range(7, -1, -1):
        bit = (body >> k & 1).astype(np.int8)
        inner = partial * _NODE
        yield bit, [_cell(c, inner) for c in contexts]
        partial = partial * np.uint64(2) + bit.astype(np.uint64)


def spelling_steps(words: list[bytes]):
    """For each of the eight bit places: (bit, four cells) of every byte of the words, an end after each."""
    return byte_steps(spelled_bytes(words))


def spelling_groups(words: list[bytes]):
    """(bit, cells, times): the same decisions, those of equal bytes that have the same before them made once."""
    spelling, times = np.unique(spelled_bytes(words), return_counts=True)
    for bit, cells in byte_steps(spelling):
        yield bit, cells, times


# -------------------------------------------------------------------- mixing


def _small(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def _add(into: np.ndarray, cells: bytes, counts: bytes) -> None:
    at = np.frombuffer(cells, np.uint16)
    into[at] += np.frombuffer(counts, f"u{len(counts) // len(at)}").astype(np.int64)


class Counts:
    """A task's tables of (zeros, ones), one after the other."""

    def __init__(self, sizes: list[int]):
        self.cells = [np.zeros(2 * n, np.int64) for n in sizes]

    def add(self, bit: np.ndarray, cells: list[np.ndarray], times: np.ndarray | int = 1) -> None:
        for t, c in zip(self.cells, cells):
            np.add.at(t, 2 * c + bit, times)

    def rows(self) -> pa.RecordBatch:
        """(kind, part, cells, counts): what is not zero, in parts of bounded size."""
        out = [(-1, 0, b"", b"")]  # for the schema's sake, where nothing was counted
        for kind, t in enumerate(self.cells):
            for part in range(0, len(t), 2 * CELLS):
                own = t[part:part + 2 * CELLS]
                at = np.flatnonzero(own)
                if len(at):
                    out.append((kind, part // (2 * CELLS), at.astype(np.uint16).tobytes(), _small(own[at])))
        kinds, parts, cells, counts = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()),
                                           pa.array(cells, pa.binary()), pa.array(counts, pa.binary())],
                                          ["kind", "part", "cells", "counts"])


ROWS = "kind int, part int, cells binary, counts binary"


def _odds(zeros: np.ndarray, ones: np.ndarray):
    """Log odds of a one, and how many decisions stand behind them in powers of four, up to 7."""
    total = zeros + ones
    return (np.log((ones + PRIOR) / (zeros + PRIOR)),
            np.minimum(7, np.ceil(np.log2(total + 1.0) / 2)).astype(np.int64))


def _gate(seen) -> np.ndarray:
    return seen[-1] * 8 + seen[-2]


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -14, 14)))


def _gathered(batches):
    """The batches, small ones put together: the more there is at once, the more is equal in it."""
    own, size = [], 0
    for batch in batches:
        own.append(batch)
        size += batch.nbytes
        if size > GATHERED_BYTES:
            yield pa.concat_batches(own)
            own, size = [], 0
    if own:
        yield pa.concat_batches(own)


def merged(rows: DataFrame) -> DataFrame:
    """The tasks' rows summed by (kind, part): streamed through, one sum at a time in memory for each part."""
    def run(batches):
        sums: dict = {}
        for batch in batches:
            for kind, part, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
                own = sums.setdefault((kind, part), np.zeros(2 * CELLS, np.int64))
                _add(own, cells, counts)
        for (kind, part), own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                 pa.array([_small(own[at])], pa.binary())], ["kind", "part", "cells", "counts"])

    return rows.repartition("kind", "part").mapInArrow(run, ROWS)


def tables(rows: DataFrame, sizes: list[int]) -> list[np.ndarray]:
    """The summed tables: at most ``SLOTS`` cells each whatever the input, which bounds what the driver sees."""
    sums = [np.zeros(2 * n, np.int64) for n in sizes]
    for r in merged(rows.where("kind >= 0")).toLocalIterator():
        _add(sums[r["kind"]][r["part"] * 2 * CELLS:], r["cells"], r["counts"])
    return sums


def without_itself(sums: list[np.ndarray]) -> dict:
    """The odds at each (cell, bit) and the evidence of each cell as they are without the one decision that is predicted."""
    odds, seen = [], []
    for t in sums:
        zeros, ones, own = t[0::2], t[1::2], np.empty(len(t), np.float32)
        own[0::2], _ = _odds(np.maximum(zeros - 1, 0), ones)
        own[1::2], _ = _odds(zeros, np.maximum(ones - 1, 0))
        odds.append(own)
        seen.append(_odds(np.maximum(zeros + ones - 1, 0), 0)[1].astype(np.uint8))
    return {"odds": odds, "seen": seen}


class Slopes:
    """For each gate the slope and the curvature of the cost along the weights, summed over decisions."""

    def __init__(self, model: dict, weights: np.ndarray):
        self.model, self.weights, n = model, weights.astype(np.float32), len(weights)
        self.slope, self.curve = np.zeros((GATES, n)), np.zeros((GATES, n, n))

    def add(self, bit: np.ndarray, cells: list[np.ndarray], times: np.ndarray | None = None) -> None:
        if not len(bit):
            return
        gate = _gate([s[c] for s, c in zip(self.model["seen"][-2:], cells[-2:])])
        order = np.argsort(gate, kind="stable")
        x = np.empty((len(cells), len(bit)), np.float32)
        for own, o, c in zip(x, self.model["odds"], cells):
            own[:] = o[2 * c + bit][order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=GATES))])
        parts = [(g, slice(ends[g], ends[g + 1])) for g in np.flatnonzero(np.diff(ends))]
        mixed = np.concatenate([self.weights[:, g] @ x[:, at] for g, at in parts])
        p = _chance(mixed)
        wrong, spread = bit[order] - p, p * (1 - p)
        if times is not None:
            often = times[order].astype(np.float32)
            wrong, spread = wrong * often, spread * often
        for g, at in parts:
            self.slope[g] += x[:, at] @ wrong[at]
            self.curve[g] += (x[:, at] * spread[at]) @ x[:, at].T

    def rows(self) -> pa.RecordBatch:
        """(place, value) of what is not zero, slopes first."""
        values = np.concatenate([self.slope.ravel(), self.curve.ravel()])
        at = np.flatnonzero(values)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(values[at])], ["place", "value"])


def first_weights(n: int) -> np.ndarray:
    return np.full((n, GATES), 1.0 / n + 0.1)


def stepped(weights: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Newton's step of each gate's weights, damped where few decisions stand behind it."""
    return weights + np.linalg.solve(curve + STILL * np.eye(len(weights)), slope[:, :, None])[:, :, 0].T


def learned_weights(rows: DataFrame, sums: list[np.ndarray], steps) -> np.ndarray:
    """The weights of each table and gate: ``PASSES`` Newton steps over every decision of ``rows``, summed by Spark.

    ``steps(batch)`` gives the (bit, cells) of a batch, or (bit, cells, times)
    where equal decisions are made once. What was counted holds each decision
    itself, so that is taken out before it is predicted.
    """
    sent, n = rows.sparkSession.sparkContext.broadcast(without_itself(sums)), len(sums)
    weights = first_weights(n)
    for _ in range(PASSES):
        def run(batches, weights=weights):
            slopes = Slopes(sent.value, weights)
            for batch in _gathered(batches):
                for step in steps(batch):
                    slopes.add(*step)
            yield slopes.rows()

        values = np.zeros(GATES * n * (n + 1))
        for r in rows.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
            values[r["place"]] = r["value"]
        weights = stepped(weights, values[:GATES * n].reshape(GATES, n), values[GATES * n:].reshape(GATES, n, n))
    sent.unpersist()
    return weights


def fitted(sums: list[np.ndarray], decisions=(), weights: np.ndarray | None = None) -> dict:
    """What prediction needs: the odds and the evidence of each cell, and the weights, else those of a step over ``decisions``."""
    if weights is None:
        slopes = Slopes(without_itself(sums), first_weights(len(sums)))
        for bit, cells in decisions:
            slopes.add(bit, cells)
        weights = stepped(slopes.weights, slopes.slope, slopes.curve)
    odds, seen = zip(*(_odds(t[0::2], t[1::2]) for t in sums))
    return {"odds": [o.astype(np.float32) for o in odds], "seen": [s.astype(np.uint8) for s in seen],
            "weights": list(weights.astype(np.float32))}


def _inputs(model, cells):
    """(the odds of each table, the gate) at some cells."""
    return [o[c] for o, c in zip(model["odds"], cells)], model["seen"][-1][cells[-1]] * np.uint8(8) + model["seen"][-2][cells[-2]]


def _cost(odds: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The natural logarithm of the chance of each bit, negative."""
    return -np.log1p(np.exp(np.clip(np.where(bit == 1, -odds, odds), -14, 14)))


def spelled(words: list[bytes], model: dict) -> np.ndarray:
    """log10 of the chance of each word's bytes and its end."""
    if not words:
        return np.zeros(0)
    total = 0
    spelling, at = np.unique(spelled_bytes(words), return_inverse=True)
    for bit, cells in byte_steps(spelling):
        odds, gate = _inputs(model, cells)
        total = total + _cost(sum(w[gate] * x for w, x in zip(model["weights"], odds)), bit)
    sizes = np.array([len(w) + 1 for w in words])
    return np.add.reduceat(total.astype(np.float64)[at], np.cumsum(sizes) - sizes) / np.log(10)


def scored(ids: np.ndarray, sizes: np.ndarray, tree, model: dict) -> np.ndarray:
    """log10 of the chance of each text's way through the tree, its weights refined segment by segment."""
    # Texts by falling length: those that reach a segment come first.
    longest = np.argsort(-sizes, kind="stable")
    lengths = sizes[longest]
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ids = ids[place + np.repeat((np.cumsum(sizes) - sizes)[longest], lengths)]
    segment = np.minimum(place // SEGMENT, 65535).astype(np.uint16)
    order = np.argsort(segment, kind="stable")
    b = tree_bits(ids, lengths, tree, order)
    doc = np.repeat(np.arange(len(sizes)), lengths)[order][b.token]
    odds, gate = _inputs(model, b.cells)
    sign = b.bit.astype(np.float32) * 2 - 1
    odds = [np.multiply(x, sign, out=x) for x in odds]  # of what comes
    where = doc * GATES + gate
    own = [np.tile(w, len(sizes)) for w in model["weights"]]
    total = np.zeros(len(sizes))
    ends = np.searchsorted(b.token, np.flatnonzero(np.diff(segment[order], append=-1)), "right")
    reach = doc[ends - 1] + 1
    for start, end, there, further in zip(np.append(0, ends), ends, reach, np.append(reach[1:], 0)):
        at, of, xs = where[start:end], doc[start:end], [x[start:end] for x in odds]
        against = -sum(w[at] * x for w, x in zip(own, xs))
        np.exp(np.clip(against, -14, 14, out=against), out=against)  # the odds against what comes
        total[:there] -= np.bincount(of, np.log1p(against), there)
        if further:
            on = np.searchsorted(of, further)  # the rest ends here
            missed = against[:on] / (1 + against[:on])
            spread, at = missed * (1 - missed), at[:on]
            for w, x in zip(own, xs):
                x = x[:on]
                wx, xx = (np.bincount(at, y, further * GATES) for y in (missed * x, spread * x * x))
                w[:further * GATES] += (wx / (len(xs) * xx + STIFF)).astype(np.float32)
    out = np.empty(len(sizes))
    out[longest] = total
    return out / np.log(10)


# --------------------------------------------------------------- the operator


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row for each document.

    ``base_score`` is the add-0.1 estimate from single tokens, ``score`` the
    model's log10 probability of the text; both learn from rows not held out.
    """
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    path = scratch_path(spark, "blocks")
    blocks(docs, text, doc_id).write.option("compression", "zstd").parquet(path)
    held = spark.read.parquet(path)
    texts = held.where("tokens IS NOT NULL").select("block", "doc_id", "held_out", "tokens")
    entries = held.where("words IS NOT NULL").select("block", F.posexplode(F.arrays_zip("words", "trained")).alias("place", "e"))
    entries = entries.select("block", "place", F.col("e.words").alias("word"), F.col("e.trained").alias("trained"))
    vocabulary = written(entries.groupBy("word").agg(F.sum("trained").alias("c")))

    docs_in = texts.agg(F.count(F.when(~F.col("held_out"), 1))).first()[0]
    sums = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = int(sums[0]) + docs_in, int(sums[1]) + (docs_in > 0)
    top = vocabulary.where("c > 0").orderBy(F.col("c").desc(), "word").limit(TREE_WORDS).collect()
    ids = {bytes(r["word"]): i for i, r in enumerate(top, 2)}
    rest = int(sums[0]) - sum(r["c"] for r in top)
    tree = huffman([rest + 1, docs_in + 1, *(r["c"] for r in top)])
    sent_ids, sent_tree = sc.broadcast(ids), sc.broadcast(vars(tree))

    # Good and Turing: what escapes once stands for what will be new.
    once = vocabulary.where("c = 1").count() - sum(r["c"] == 1 for r in top)
    unseen = min(0.99, max(0.01, once / rest)) if rest else 0.99

    def spelling(batch):
        words = [w for w in batch.column(0).to_pylist() if w not in sent_ids.value]
        yield from spelling_groups(words) if words else ()

    def counted(steps, sizes):
        def run(batches):
            counts = Counts(sizes)
            for batch in _gathered(batches):
                for step in steps(batch):
                    counts.add(*step)
            yield counts.rows()
        return run

    learned = vocabulary.where("c > 0").select("word")
    sizes = [SLOTS] * len(ORDERS)
    sums_spelling = tables(learned.mapInArrow(counted(spelling, sizes), ROWS), sizes)
    sent_spelling = sc.broadcast(fitted(sums_spelling, weights=learned_weights(learned, sums_spelling, spelling)))

    def cost(batches):
        for batch in _gathered(batches):
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            number = np.array([sent_ids.value.get(w, 0) for w in words], np.int32)
            value, rare = np.zeros(len(words)), np.flatnonzero(number == 0)
            spell = spelled([words[i] for i in rare], sent_spelling.value)
            value[rare] = np.log10((1 - unseen) * c[rare] / max(rest, 1) + unseen * 10.0 ** np.maximum(spell, -290))
            far = rare[spell < -290]
            value[far] = np.where(c[far] > 0, value[far], np.log10(unseen) + spell[spell < -290])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(number), pa.array(value)],
                                             ["word", "c", "id", "cost"])

    costs = written(vocabulary.mapInArrow(cost, "word binary, c long, id int, cost double"))
    met = entries.select(F.col("block").alias("of"), "place", "word").join(costs, "word").select("of", "place", "c", "id", "cost")

    def code(rows: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        at = words["place"].to_numpy(np.int64)
        c, number, value = np.zeros(len(at) + 1), np.zeros(len(at) + 1, np.uint16), np.zeros(len(at) + 1)
        c[at], number[at], value[at] = words["c"], words["id"], words["cost"]
        known = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        end = np.log10((docs_in + 0.1) / (n + 0.1 * (v + 1)))
        out = []
        for tokens in rows["tokens"]:
            own = np.frombuffer(tokens, np.uint32)
            out.append((len(own) + 1, int(np.count_nonzero(c[own])) + (docs_in > 0), float(known[own].sum() + end),
                        float(value[own].sum()), np.append(number[own], np.uint16(END)).tobytes()))
        made = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "rare", "ids"])
        made.insert(0, "doc_id", rows["doc_id"].to_numpy())
        made.insert(1, "held_out", rows["held_out"].to_numpy())
        return made

    id_type = held.schema["doc_id"].dataType.simpleString()
    coded = written(texts.groupBy("block").cogroup(met.groupBy("of")).applyInPandas(
        code, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, rare double, ids binary"))
    discard(spark, path)

    sizes = [len(top) + 1, SLOTS, SLOTS, SLOTS]

    def chunks(batch, column, most):
        """(ids, tokens of each) of some rows, bounded but for a single longer text."""
        own, size = [], 0
        for i, x in enumerate(batch.column(column).to_pylist()):
            own.append(np.frombuffer(x, np.uint16))
            size += len(own[-1])
            if size > most or i == batch.num_rows - 1:
                yield np.concatenate(own).astype(np.int64), np.array([len(o) for o in own])
                own, size = [], 0

    def decisions(batch):
        tree = SimpleNamespace(**sent_tree.value)
        for words, lengths in chunks(batch, 0, GROUP_TOKENS):
            yield from tree_groups(words, lengths, tree)

    learned = coded.where("NOT held_out").select("ids")
    model = tables(learned.mapInArrow(counted(decisions, sizes), ROWS), sizes)
    sent_model = sc.broadcast(fitted(model, weights=learned_weights(learned, model, decisions)))

    def finish(batches):
        tree = SimpleNamespace(**sent_tree.value)
        for batch in batches:
            found = [scored(words, lengths, tree, sent_model.value) for words, lengths in chunks(batch, 6, CHUNK_TOKENS)]
            total = np.concatenate(found) + batch.column(5).to_numpy() if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(total)],
                                             ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    done = coded.mapInArrow(finish, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return done.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
                       "base_score", "score")
