"""MinHash near-duplicates beside all pairs of whole sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import minhash, setpairs

from . import brute


def shingle_set(text):
    words = brute.low_words(text)
    return frozenset(tuple(words[i:i + 3]) for i in range(len(words) - 2)) if len(words) >= 3 else frozenset([tuple(words)] if words else [])


def expected(rows):
    """(doc_id, n, component, kept) from all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for a, (i, _) in enumerate(rows):
        least.setdefault(find(a), []).append(i)
    least = {r: min([i for i in ids if i is not None], default=None) for r, ids in least.items()}
    return sorted(repr((i, len(sets[a]), least[find(a)], i == least[find(a)])) for a, (i, _) in enumerate(rows))


def corpus():
    """Copies from far above to far below the similarity, chains, a shared passage, short and empty texts."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(500)]
    shared, texts = [rng.choice(vocabulary) for _ in range(50)], []
    for _ in range(10):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(30, 250))] + shared
        texts.append(own)
        for edits in (1, 1, 2, 3, 5, 8, 13):
            copy = list(texts[-1] if edits % 2 else own)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + [None, "", " \t", "a b", "A  b", "b a", "a", "a b c", "a b c d e f g h i", "a b c d e f g h", "É x é", "x" * 9000]
    texts += [texts[3], texts[3].upper(), texts[20]]
    rng.shuffle(texts)
    return [(None if i in (7, 30) else i // 2 if i in (50, 51) else i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small", [minhash.SMALL, 3])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)  # 3: hubs, sets left outside and opened keys
    monkeypatch.setattr(setpairs, "PAIRS_EACH", 4)
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"sid": F.lit("own"), "n": F.lit(0)}).repartition(3)
    found = minhash.near_duplicates(frame)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(repr, map(tuple, found.collect()))) == expected(rows)


def test_smallest_table(spark, tables):
    rows = [(r["doc_id"], r["text"]) for r in tables["documents"].collect()]
    assert sorted(map(repr, map(tuple, minhash.near_duplicates(tables["documents"]).collect()))) == expected(rows)


def test_nothing_and_no_words(spark):
    kind = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = [(2, ""), (1, None), (None, " ")]
    assert sorted(map(repr, map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, kind)).collect()))) == expected(rows)


def test_signatures_in_reach_meet_in_two_chunks():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 16, (200, minhash.CHUNKS * minhash.WIDTH)).astype(np.uint16)
    y = x.copy()
    for row in y:
        at = rng.choice(len(row), rng.integers(0, minhash.FARTHEST + 1), replace=False)
        row[at] ^= rng.integers(1, 1 << 16, len(at)).astype(np.uint16)
    met = sum(np.any(minhash.chunk_keys(x, c) == minhash.chunk_keys(y, c), axis=1).astype(int) for c in range(minhash.CHUNKS))
    assert met.min() >= 2


def test_symbols_differ_as_often_as_sets_do():
    rng, ratio = np.random.default_rng(9), []
    for _ in range(60):
        whole = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        ratio.append(np.mean(minhash.signature(whole[:255]) != minhash.signature(whole)))
    assert abs(np.mean(ratio) - 0.15) < 0.01


def test_sets_that_only_share_what_many_share_do_not_meet(spark):
    """Edited copies of one text too far from each other, and texts around one passage: no pairs meet; those of a passage and little else do."""
    rng = random.Random(5)
    base, passage = [f"b{i}" for i in range(150)], [f"p{i}" for i in range(60)]

    def edited(i, n):
        copy = list(base)
        for at in rng.sample(range(len(copy)), n):
            copy[at] = f"e{i}x{at}"
        return " ".join(copy)

    texts = [edited(i, 12) for i in range(60)] + [" ".join([f"o{i}x{j}" for j in range(40)] + passage) for i in range(60)]
    alike = [" ".join([f"a{i}", *passage]) for i in range(4)]
    rows = list(enumerate(texts + alike))
    bodies = spark.createDataFrame([(i, t.encode()) for i, t in rows], "sid long, body binary")
    sets = spark.createDataFrame([(i, len(shingle_set(t)), i if i < len(texts) else 200 + i % 2) for i, t in rows], "sid long, n long, root long")
    met = {(r["u"], r["v"]) for r in setpairs.sharing_rare(sets, bodies, 85, 3).collect()}
    own = [shingle_set(t) for _, t in rows]
    linked = {(a, b) for a, _ in rows for b in range(a) if 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])}
    first = len(texts)
    assert {p for p in linked if (p[0] - p[1]) % 2 or p[1] < first} <= met  # the others have one root
    assert all(v >= first and (u - v) % 2 for u, v in met)


def test_many_sets_of_one_key(spark, monkeypatch):
    """Full keys of edited copies on both sides of the similarity, as all pairs have them."""
    monkeypatch.setattr(minhash, "SMALL", 8)
    rng, base = random.Random(6), [f"b{i}" for i in range(120)]
    rows = []
    for i in range(90):
        copy = list(base)
        for at in rng.sample(range(len(copy)), rng.randrange(8)):
            copy[at] = rng.choice(["", "x ", "y "]) + f"e{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(repr, map(tuple, found.collect()))) == expected(rows)


@pytest.mark.parametrize("bits", [20, 2])
def test_only_first_values_leave_a_text(spark, monkeypatch, bits):
    """No step has a row for each shingle, and no similar pair is missed however many values share a count."""
    rng, base, steps = random.Random(8), [f"b{i}" for i in range(100)], []
    rows = []
    for i in range(80):
        copy = list(base)
        for at in rng.sample(range(len(copy)), rng.randrange(9)):
            copy[at] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(copy)))
    own = [shingle_set(t) for _, t in rows]
    keep = setpairs.written
    monkeypatch.setattr(setpairs, "written", lambda df: steps.append(keep(df)) or steps[-1])
    bodies = spark.createDataFrame([(i, t.encode()) for i, t in rows], "sid long, body binary")
    sets = spark.createDataFrame([(i, len(s), i % 7) for i, s in enumerate(own)], "sid long, n long, root long")
    met = {(r["u"], r["v"]) for r in setpairs.sharing_rare(sets, bodies, 85, 3, **({"bits": bits} if bits != 20 else {})).collect()}
    linked = {(a, b) for a in range(len(rows)) for b in range(a) if (a - b) % 7 and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])}
    assert linked and linked <= met
    assert max(s.count() for s in steps) < 0.25 * sum(map(len, own))


def test_tasks_hand_on_blocks_of_counts(spark):
    """However many values the texts have, a task's counts are a row for each block of the table at most, and sum up to all."""
    texts = [" ".join(f"t{i}x{j}" for j in range(150)).encode() for i in range(100)] * 2
    held = spark.createDataFrame([(t,) for t in texts], "body binary").repartition(3)
    expect = np.zeros(1 << 20, np.int64)
    for t in texts:
        np.add.at(expect, (setpairs.text_set(t, 3) >> np.uint64(44)).astype(np.int64), 1)
    assert setpairs.task_counts(held, 3).count() <= 3 * 64 < 0.02 * np.count_nonzero(expect)
    assert np.array_equal(setpairs.cell_counts(held, 3), expect)


@pytest.mark.parametrize("group", [40, 80])
def test_copies_and_sets_beside_them_are_not_looked_at_pair_by_pair(spark, monkeypatch, group):
    """One component and as many sets too far from it: what the join looks at does not grow with the product of both."""
    rng, base, seen = random.Random(group), [f"b{i}" for i in range(150)], []

    def edited(i, n):
        copy = list(base)
        for at in rng.sample(range(1, 50), n):
            copy[3 * at] = f"e{i}x{at}"  # each edit makes three shingles of its own
        return " ".join(copy)

    texts = [edited(i, i % 2) for i in range(group)] + [edited(group + i, 5 + i % 3) for i in range(group)] + [edited(-1 - i, 3) for i in range(3)]
    own = [shingle_set(t) for t in texts]
    sides = setpairs.sides
    monkeypatch.setattr(setpairs, "sides", lambda *a: seen.append(sides(*a)) or seen[-1])
    bodies = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "sid long, body binary")
    sets = spark.createDataFrame([(i, len(s), max(i, group)) for i, s in enumerate(own)], "sid long, n long, root long")
    met = {(r["u"], r["v"]) for r in setpairs.sharing_rare(sets, bodies, 85, 3).collect()}
    linked = {(a, b) for a in range(len(own)) for b in range(a) if a > group and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b])}
    assert linked and linked <= met
    (x, y), = seen
    whole = y.drop("band").distinct()  # without the sizes
    looked = [a.join(b, keys).count() for a, b, keys in ((x, y, ["token", "meets", "band"]), (x.drop("band"), whole, ["token", "meets"]))]
    assert looked[0] < 30 * group and looked[1] > 5 * group * group
