"""SentencePiece encoding that keeps the source place of every piece, and decoding.

Normalisation goes through the model's compiled character map: at each place
the longest prefix the map knows is replaced, anything else is copied one
character at a time, and the source byte of every normalised byte is recorded.
The library segments the text; the pieces' lengths, laid along the normalised
bytes, are then projected through that record, so each piece has a span of
original bytes. A model without a map (identity) takes a vectorised path.

Texts go to tasks as they lie; nothing is shuffled. The model file is read from
its path on each executor and must be installed there.

Defined results: a null text is encoded as an empty one, which has no ids.
Bytes that are not UTF-8 are read as U+FFFD, as the library does. Rows are
independent, so ties, repeated rows, null ids and empty tables need no rule;
``encode`` keeps all columns in a struct and clashes with none of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import packed, texts_in, with_results

SPACE = "▁".encode()
#: Characters handed to the library at once: bounds a task's memory.
CHUNK_CHARS = 1 << 20


class CharacterMap:
    """The model's map: a double-array trie of source strings, and their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], "<u4").tolist()
        self.replacements = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest known string at a place."""
        units, found = self.units, None
        if not units:
            return None
        node = (units[0] >> 10) << ((units[0] & 0x200) >> 6)
        for n, byte in enumerate(memoryview(text)[at:], 1):
            node ^= byte
            if node >= len(units) or units[node] & 0x800000FF != byte:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = n, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        start = found[1]
        return found[0], self.replacements[start:self.replacements.index(b"\0", start)]


class Normalizer:
    """Normalised bytes, with the source byte of each and of the end."""

    def __init__(self, character_map: bytes = b"", dummy_prefix: bool = True, squeeze: bool = False, escape: bool = True):
        self.map = CharacterMap(character_map)
        self.dummy_prefix, self.squeeze = dummy_prefix, squeeze
        self.space = SPACE if escape else b" "

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            return self._copied(text)
        return self._mapped(text)

    def _copied(self, text: bytes) -> tuple[bytes, np.ndarray]:
        wide = np.where(np.frombuffer(text, np.uint8) == 0x20, len(self.space), 1)
        source = np.repeat(np.arange(len(text)), wide)
        lead = len(self.space) if self.dummy_prefix else 0
        return (self.space * bool(lead) + text.replace(b" ", self.space),
                np.concatenate([np.zeros(lead, np.int64), source, [len(text)]]))

    def _step(self, text: bytes, at: int) -> tuple[int, bytes]:
        known = self.map.longest(text, at)
        if known:
            return known
        lead = text[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return size, text[at:at + size]

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        at, out, source = 0, bytearray(), []
        while self.squeeze and at < len(text):
            size, new = self._step(text, at)
            if new != b" ":
                break
            at += size
        if at == len(text):
            return b"", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out += self.space
            source += [at] * len(self.space)
        after_space = self.squeeze
        while at < len(text):
            size, new = self._step(text, at)
            if after_space:
                new = new.lstrip(b" ")
            for byte in new:
                piece = self.space if byte == 0x20 else bytes([byte])
                out += piece
                source += [at] * len(piece)
            if new:
                after_space = self.squeeze and new.endswith(b" ")
            at += size
        end = at
        while self.squeeze and out.endswith(self.space):
            del out[-len(self.space):]
            end = source[len(out)]
            del source[len(out):]
        return bytes(out), np.array([*source, end], np.int64)


class Model:
    """A processor, the normaliser its file describes, and each piece's length in normalised bytes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as files

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        described = files.ModelProto()
        described.ParseFromString(self.processor.serialized_model_proto())
        n = described.normalizer_spec
        self.normalize = Normalizer(n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces,
                                    n.escape_whitespaces)
        self.lengths = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in described.pieces], np.int64)
        self.unknown = next((i for i, p in enumerate(described.pieces) if p.type == p.UNKNOWN), -1)
        self.shown = [str(i) for i in range(len(self.lengths))]

    def spans(self, text: str, ids: list[int]) -> np.ndarray:
        """(start, end) of each piece in the text's UTF-8 bytes."""
        lengths = self.lengths[ids] if ids else np.zeros(0, np.int64)
        if self.unknown in ids:
            pieces = self.processor.encode(text, out_type=str)
            lengths = np.where(np.array(ids) == self.unknown, [len(p.encode()) for p in pieces], lengths)
        source = self.normalize(text.encode())[1]
        ends = np.cumsum(lengths)
        return np.stack([source[ends - lengths], source[ends]], axis=1) if ids else np.zeros((0, 2), np.int64)


def _chunks(texts: list[str]):
    """Slices of bounded size, a longer text alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_CHARS:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def _sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


FIELDS = {
    "ids": T.ArrayType(T.IntegerType()), "starts": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(), "spans_sha256": T.StringType(), "n_covered": T.LongType(),
}


def _results(model: Model, texts: list[str], wanted: tuple[str, ...]):
    """One dict of the wanted fields for each text."""
    encoded = model.processor.encode(texts, num_threads=1)
    decoded = model.processor.decode(encoded) if {"decoded", "decoded_sha256"} & set(wanted) else texts
    for text, ids, back in zip(texts, encoded, decoded):
        spans = model.spans(text, ids)
        make = {
            "ids": lambda: ids, "starts": lambda: spans[:, 0].tolist(), "ends": lambda: spans[:, 1].tolist(),
            "decoded": lambda: back, "n_tokens": lambda: len(ids),
            "ids_sha256": lambda: _sha(",".join([model.shown[i] for i in ids])), "decoded_sha256": lambda: _sha(back),
            "spans_sha256": lambda: _sha(spans.astype("<i8").tobytes()),
            "n_covered": lambda: int((spans[:, 1] - spans[:, 0]).sum()),
        }
        yield {w: make[w]() for w in wanted}


def encode(docs: DataFrame, model_path: str, wanted: tuple[str, ...] = ("ids", "starts", "ends"),
           text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(__row, the ``wanted`` of FIELDS): each document (or its columns ``carry``) as a struct, beside its encoding.

    ``starts`` and ``ends`` are the pieces' spans in the UTF-8 bytes of the text.
    """
    rows = packed(docs, text, carry)
    fields = [T.StructField(w, FIELDS[w]) for w in wanted]

    def run(batches):
        model = Model(model_path)
        kinds = {"array<int>": pa.list_(pa.int32()), "string": pa.string(), "bigint": pa.int64()}
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in texts_in(batch)]
            for part in _chunks(texts):
                got = list(_results(model, texts[part], wanted))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.start, part.stop - part.start),
                     *(pa.array([g[f.name] for g in got], kinds[f.dataType.simpleString()]) for f in fields)],
                    names=["__row", *wanted])

    return rows.mapInArrow(run, with_results(rows, fields))


def decode(rows: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text its ``ids`` stand for; null ids decode to an empty text."""
    held = rows.select(*[rows[f"`{c}`"] for c in rows.columns if c != into])

    def run(batches):
        model = Model(model_path)
        for batch in batches:
            lists = [x or [] for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.processor.decode(lists), pa.string())],
                                             names=[*batch.schema.names, into])

    return held.mapInArrow(run, T.StructType([*held.schema.fields, T.StructField(into, T.StringType())]))
