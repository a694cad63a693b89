"""Vector codes beside plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import codes


def brute(rows, parts, entries, rounds):
    """(vec_id, code, error) and the codebooks, in Python's integers."""
    key = [(r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0) for r in rows]
    kept = [r for _, r in sorted(zip(key, rows), key=lambda x: x[0])]
    whole = [[math.floor(256 * x) if abs(x) < 2 ** 44 else int(x) * 256 for x in r[1]] for r in kept]
    width = len(whole[0]) // parts
    cut = [[tuple(w[p * width:(p + 1) * width]) for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), i) for i, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for c in cut:
                held[best(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(col) // len(h) for col in zip(*h)) if h else old for h, old in zip(held, books[p])]
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    return [(r[0], r[2], "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for r, f in zip(kept, found)], books


@pytest.mark.parametrize("bits", [4, 20, 40, 62])
def test_limb_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(-(1 << bits // 2), 1 << bits // 2, (3, 50, 7)) - rng.integers(0, 2, (3, 50, 7))
    y = rng.integers(-(1 << (bits - bits // 2 - 1)), 1 << (bits - bits // 2 - 1), (3, 20, 7))
    y[0, 0], x[0, 0] = -(1 << (bits - bits // 2 - 1)), -(1 << bits // 2)
    if bits == 62:
        x, y = x // 8, y // 8
    assert (codes.limb_product(x, y) == np.matmul(x.astype(object), y.astype(object).swapaxes(1, 2))).all()


@pytest.mark.parametrize("size", [1.0, 1e6, 1e30])
def test_codes_against_plain_integers(spark, size):
    rng = random.Random(4)
    rows = [(i // 2 if i % 9 == 0 else i, [rng.choice([-1, 1]) * rng.random() * size for _ in range(8)], rng.choice([None, 1, 2])) for i in range(70)]
    rows += [rows[5], rows[5], (None, rows[3][1], None), (90, [0.0] * 8, 7)]
    bad = [(91, None, 1), (92, [1.0, None] * 4, 1), (93, [float("nan")] * 8, 1), (94, [float("inf")] + [0.0] * 7, None)]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label long").withColumn("code", F.lit("own")).repartition(3)
    found, books = codes.encode(frame, parts=4, entries=6)
    want, made = brute(rows, 4, 6, codes.ROUNDS)
    assert [[tuple(map(int, e)) for e in b] for b in books] == made
    fits = [e if e < 1 << 63 else None for *_, e in want]
    of_label = {w[1]: [x[3] for x in want if x[1] == w[1]] for w in want}
    of_label = {k: sum(v) if max(v) < 1 << 63 and sum(v) < 1 << 63 else None for k, v in of_label.items()}
    assert sorted(map(repr, map(tuple, found.select("vec_id", "label", "code", "error", "label_error").collect()))) == sorted(
        repr((w[0], w[1], w[2], e, of_label[w[1]])) for w, e in zip(want, fits))
    assert codes.codebooks_digest(books) == hashlib.sha256(",".join(str(v) for b in made for e in b for v in e).encode()).hexdigest()
    if size == 1.0:
        back = codes.decoded(want[0][2], books)
        assert len(back) == 8 and all(isinstance(v, float) for v in back)


def test_few_rows_and_none(spark):
    kind = "vec_id long, embedding array<float>, label int"
    none, books = codes.encode(spark.createDataFrame([], kind))
    assert none.count() == 0 and books.size == 0 and codes.codebooks_digest(books) == hashlib.sha256(b"").hexdigest()
    empty = codes.encode(spark.createDataFrame([(1, [], None), (2, [], None)], kind))[0].collect()
    assert {(r["code"], r["error"], r["label_error"]) for r in empty} == {("00" * 16, 0, 0)}
    one = codes.encode(spark.createDataFrame([(1, [0.5] * 16, None)], kind))[0].first()
    assert (one["code"], one["error"]) == ("00" * 16, 0)
    with pytest.raises(Exception, match="length|components"):
        codes.encode(spark.createDataFrame([(1, [0.5] * 16, None), (2, [0.5] * 32, None)], kind))[0].count()
