"""The trie of shared openings beside a dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siftwell.llm import prefixtrie

KIND = "conv_id long, turn long, role string, text string"


def original(rows):
    held = {}
    for c, turn, role, text in rows:
        if c is not None:
            held.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in held.items()}


def shared(held):
    out = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = held.get(int(c / 100) * 100, [])[:h] + own[h:]  # towards zero, as in SQL
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault((d, tuple(turns[:d])), []).append(c)
    kids = {}
    for d, prefix in members:
        if d:
            kids.setdefault((d - 1, prefix[:-1]), []).append((d, prefix))

    def below(node):
        work, seen = [node], []
        while work:
            seen.append(work.pop())
            work += kids.get(seen[-1], [])
        return seen

    out = []
    for node, held in members.items():
        d, prefix = node
        under = below(node)
        ends = ",".join(map(str, sorted(c for c in held if len(convs[c]) == d)))
        out.append((min(held), d, min(members[d - 1, prefix[:-1]]) if d else None, len(held), len(kids.get(node, [])),
                    sum(u not in kids for u in under), sum((len(members[u]) - 1) * len(u[1][-1][1]) for u in under if u[0]),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def found(paths, convs):
    nodes, _ = prefixtrie.trie(paths, convs)
    return sorted(map(repr, map(tuple, nodes.collect())))


def awkward():
    rng, rows = random.Random(8), []
    said = ["", "hi", "hi ", "née 日本", None, "a,b", "x" * 5000]
    for c in [*range(0, 30), *range(100, 140), 250, 3000, -7]:
        n = rng.choice([1, 1, 2, 3, 4, 6, 9]) if c != 110 else 45
        for t in range(n):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(said[:rng.choice([2, 3, 7])])))
    rows += [(c, t, "user", "the same") for c in range(300, 340) for t in range(5)]  # one very common conversation
    rows += [rows[3], rows[3], (None, 1, "user", "nobody"), (401, 0, "user", "alone"), (402, 0, "r" * 40, "b"), (402, 0, "r" * 41, "a")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


def test_openings_and_nodes(spark, rows, monkeypatch):
    monkeypatch.setattr(prefixtrie, "PIECE", 20)  # several pieces for one node
    frame = spark.createDataFrame(rows, KIND).withColumns({"depth": F.lit(9), "symbol": F.lit("own")}).repartition(5)
    held = original(rows)
    made = prefixtrie.sequences(frame)
    assert {r["conv"]: r["length"] for r in made[1].collect()} == {c: len(t) for c, t in held.items()}
    assert found(*made) == brute(held)
    again = prefixtrie.with_shared_openings(*made)
    assert any(r["length"] == 0 for r in again[1].collect())
    assert found(*again) == brute(shared(held))


def test_members_of_nodes(spark, rows):
    paths, convs = prefixtrie.sequences(spark.createDataFrame(rows, KIND))
    _, names = prefixtrie.trie(paths, convs)
    held, least = original(rows), {}
    for c, turns in held.items():
        for d in range(len(turns) + 1):
            least.setdefault((d, tuple(turns[:d])), []).append(c)
    want = sorted((c, d, min(cs)) for (d, _), cs in least.items() for c in cs)
    assert sorted(map(tuple, names.collect())) == want


def test_nothing_and_one(spark):
    paths, convs = prefixtrie.with_shared_openings(*prefixtrie.sequences(spark.createDataFrame([], KIND)))
    assert found(paths, convs) == []
    assert found(*prefixtrie.sequences(spark.createDataFrame([(5, None, None, None)], KIND))) == brute({5: [("", "")]})
