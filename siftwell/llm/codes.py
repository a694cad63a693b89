"""Product codes of vectors, trained and assigned in exact integers.

A vector is cut into ``PARTS`` equal parts; each part is coded by the nearest
entry of its own codebook. Components become integers ``floor(256 * x)``, and
everything after that is exact, so codes, errors and codebooks do not depend
on how the rows lie in partitions.

Distances come from matrix products of doubles (``limb_product``): integers are
broken into limbs of so few bits that a sum of products of two limbs stays
below 2^53, where doubles are exact; the products are put together in 64-bit
integers, and the first smallest distance wins. Where 64 bits could not hold a
distance, the same steps run on Python's integers.

Spark reads the vectors once for each round. A task sends the sums and counts
of its parts for each (part, entry, place), so what is shuffled is bounded by
the codebooks times the tasks, whatever the rows or however common a vector.
The driver holds codebooks only: ``ENTRIES`` vectors.

Defined results: rows whose vector is null or holds a null, an infinity or
not-a-number are left out, so an empty table gives no rows. With fewer than
``ENTRIES`` kept rows the codebooks have an entry for each. Rows of one id are
ordered by their vector, then label; null ids come last. Repeated rows each
have their row. An error of more than 63 bits is null, as is a label's sum with
such a part. Vectors of length zero have code 00 in every part; lengths that
differ or that the parts do not divide are refused. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.session import written

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Rows whose distances a task holds at once.
BLOCK = 1024


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): 64-bit integers, or Python's where those would not do."""
    values = values.astype(np.float64)
    if not values.size or np.abs(values).max() < 2.0 ** 52 / scale:
        return np.floor(values * scale).astype(np.int64)
    each = [math.floor(x * scale) if abs(x) < 2.0 ** 52 else int(x) * scale for x in values.ravel().tolist()]
    return np.array(each, object).reshape(values.shape)


def limb_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T over the last axis, exact, for 64-bit integers whose result fits into 64 bits."""
    width = x.shape[-1]
    bits = (52 - max(0, width - 1).bit_length()) // 2

    def limbs(a):
        lower = int(np.abs(a).max(initial=0)).bit_length() // bits
        return [*[((a >> (bits * i)) & ((1 << bits) - 1)).astype(np.float64) for i in range(lower)],
                (a >> (bits * lower)).astype(np.float64)]

    total = np.zeros((*x.shape[:-1], y.shape[-2]), np.int64)
    right = limbs(y)
    for i, a in enumerate(limbs(x)):
        for j, b in enumerate(right):
            total += np.matmul(a, b.swapaxes(-1, -2)).astype(np.int64) << (bits * (i + j))
    return total


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry for parts (n, parts, width) and books (parts, entries, width)."""
    width = parts.shape[1] * max(1, parts.shape[2])
    most = max((int(abs(a).max()) for a in (parts, books) if a.size), default=0)
    fits = parts.dtype != object and books.dtype != object and 4 * most * most * width < 1 << 63
    x, y = parts.swapaxes(0, 1), books
    if fits:
        product = limb_product(x, y)
    else:
        x, y = x.astype(object), y.astype(object)
        product = np.matmul(x, y.swapaxes(1, 2)) if x.shape[2] else np.zeros((x.shape[0], x.shape[1], y.shape[1]), object)
    squares = (y * y).sum(axis=2)[:, None, :] - 2 * product
    at = np.argmin(squares, axis=2)
    least = np.take_along_axis(squares, at[:, :, None], 2)[:, :, 0] + (x * x).sum(axis=2)
    return at.T, least.T


def kept_vectors(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, label, vector) of the rows that can be coded; components as doubles."""
    whole = F.forall(vectors[f"`{vector}`"], lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                     & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return (vectors.where(vectors[f"`{vector}`"].isNotNull() & whole)
            .select(vectors[f"`{vec_id}`"].alias("vec_id"), vectors[f"`{label}`"].alias("label"),
                    vectors[f"`{vector}`"].cast("array<double>").alias("vector")))


def _parts_in(column: pa.ListArray, width: int, parts: int, scale: int):
    """Blocks of rows as integers (rows, parts, width)."""
    sizes = np.diff(column.offsets.to_numpy())
    if not (sizes == width * parts).all():
        raise ValueError(f"every vector needs {width * parts} components, some have {sizes[sizes != width * parts][0]}")
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, width)
    for at in range(0, len(column), BLOCK):
        yield scaled(flat[at:at + BLOCK], scale)


def first_codebooks(kept: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """(parts, entries, width) from the rows of the smallest ids."""
    rows = (kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector", F.col("label").asc_nulls_last()).limit(entries)
            .select("vector").collect())
    if len({len(r[0]) for r in rows}) > 1 or rows and len(rows[0][0]) % parts:
        raise ValueError(f"vectors need one length that {parts} divides: {sorted({len(r[0]) for r in rows})}")
    width = len(rows[0][0]) // parts if rows else 0
    return scaled(np.array([r[0] for r in rows], np.float64).reshape(len(rows), parts, width), scale).swapaxes(0, 1)


def refined(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """The codebooks after one round: each used entry is the floor of the mean of its parts."""
    parts, entries, width = books.shape
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books, place = sent.value, np.arange(parts) * entries
        sums, counts = np.zeros((parts * entries, width), object), np.zeros(parts * entries, np.int64)
        for b in batches:
            for x in _parts_in(b.column(0), width, parts, scale):
                at = (nearest(x, books)[0] + place).ravel()
                flat = x.reshape(-1, width)
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                small = flat.dtype != object and int(np.abs(flat).max(initial=0)) < 1 << 42
                whole = np.add.reduceat(flat[order] if small else flat[order].astype(object), first, axis=0)
                sums[used] += whole.astype(object)
                counts += np.bincount(at, minlength=len(counts))
        used = np.flatnonzero(counts)
        slot, pos = np.repeat(used, width), np.tile(np.arange(width), len(used))
        # Sums go as text, their high and low digits apart: no width of integer bounds them.
        parted = [divmod(int(s), 10 ** 18) for s in sums[used].ravel()]
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int32()), "pos": pa.array(pos, pa.int32()),
                                          "n": pa.array(np.repeat(counts[used], width)), "low": pa.array([p[1] for p in parted], pa.int64()),
                                          "high": pa.array([str(p[0]) for p in parted], pa.string())})

    found = (kept.select("vector").mapInArrow(run, "slot int, pos int, n long, low long, high string")
             .groupBy("slot", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"),
                                         F.collect_list(F.when(F.col("high") != "0", F.col("high"))).alias("high")).collect())
    made = books.astype(object)
    for r in found:
        whole = int(r["low"]) + 10 ** 18 * sum(map(int, r["high"]))
        made[r["slot"] // entries, r["slot"] % entries, r["pos"]] = whole // r["n"]
    return made.astype(np.int64) if all(-(1 << 62) < v < 1 << 62 for v in made.ravel()) else made


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts, entries, width) after ``rounds`` rounds over every kept vector."""
    books = first_codebooks(kept, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        books = refined(kept, books, scale)
    return books


def assigned(kept: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error) of every kept vector."""
    parts, entries, width = books.shape
    sent = kept.sparkSession.sparkContext.broadcast(books)
    digits = 2 * max(1, -(-max(0, entries - 1).bit_length() // 8))

    def run(batches):
        for b in batches:
            codes, errors = [], []
            for x in _parts_in(b.column(2), width, parts, scale):
                at, least = nearest(x, sent.value)
                codes += ["".join(format(v, f"0{digits}x") for v in row) for row in at.tolist()]
                errors += [e if e < 1 << 63 else None for e in map(int, least.sum(axis=1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                                             ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def codebooks_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", label: str = "label", parts: int = PARTS,
           entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error), codebooks)."""
    kept = kept_vectors(vectors, vector, vec_id, label)
    books = train(kept, parts, entries, rounds, scale)
    coded = written(assigned(kept, books, scale))
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.when(F.count("error") == F.count(F.lit(1)), whole)
    of_label = coded.groupBy(F.col("label").alias("l")).agg(
        F.when(whole <= (1 << 63) - 1, whole).cast("long").alias("label_error"))
    return coded.join(of_label, coded["label"].eqNullSafe(of_label["l"]), "left").drop("l"), books


def decoded(code: str, books: np.ndarray, scale: int = SCALE) -> list[float]:
    """The vector that a code stands for."""
    digits = len(code) // len(books)
    return [float(v) / scale for p in range(len(books)) for v in books[p][int(code[digits * p:digits * (p + 1)], 16)]]
