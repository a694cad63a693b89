"""The pipeline's near-duplicate stage beside a brute-force Jaccard of the five-word shingles themselves."""

import random

import corpus_pipeline
from siftwell.llm import minhash, simhash


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def similar(x, y):
    return 5 * len(x & y) >= 4 * len(x | y)


def stays(rows):
    """The smallest id of each component of all pairs."""
    sets, least = [shingle_set(t) for _, t in rows], [i for i, _ in rows]
    near = [(a, b) for a in range(len(rows)) for b in range(a) if similar(sets[a], sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in near:
            if least[a] != least[b]:
                least[a] = least[b] = min(least[a], least[b])
                moved = True
    return sorted(set(least))


def test_stage_on_the_smallest_table(spark, tables):
    docs = tables["documents"]
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, None).collect())
    assert got == stays([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_stage_on_edited_copies_and_chains(spark):
    """Copies from far above to far below the similarity, chains, a shared passage, short and empty texts."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    texts = []
    for _ in range(12):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(40, 300))] + shared
        texts.append(own)
        for edits in (1, 1, 2, 3, 5, 8, 13):
            copy = list(texts[-1] if edits % 2 else own)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    texts = [" ".join(t) for t in texts] + ["a b", "A  b", "b a", "a b c d e", "a b c d e f", "a b c d e"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = minhash.drop_copies(docs, 80, k=5)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == stays(rows)
    wordless = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", " ", ""])], "doc_id long, text string")
    assert minhash.drop_copies(wordless, 80, k=5).count() == 4  # linked with nothing
    assert minhash.drop_copies(docs.limit(0), 80, k=5).count() == 0


def test_one_row_of_a_repeated_id_and_text_stays(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "a"), (1, long, "a"), (2, long, "b"), (None, "lone words", "c"), (None, "lone words", "c"), (3, None, "d"), (3, None, "d"),
            (4, "another text of six words", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for drop in (lambda d: minhash.drop_copies(d, 80, k=5), simhash.drop_copies):
        kept = drop(docs)
        assert kept.columns == docs.columns
        assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, {rows[0], rows[3], rows[5], rows[7]}))
