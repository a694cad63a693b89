"""What context mixing does once where it used to do it again and again, against the plain way."""

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import mixing


def sums(steps, sizes):
    """(counts, slopes, curvatures, decisions made) of some steps."""
    steps, counts = list(steps), mixing.Counts(sizes)
    for step in steps:
        counts.add(*step)
    slopes = mixing.Slopes(mixing.without_itself(counts.cells), mixing.first_weights(len(sizes)))
    for step in steps:
        slopes.add(*step)
    return counts.cells, slopes.slope, slopes.curve, sum(len(step[0]) for step in steps)


def same(once, each):
    assert all(np.array_equal(a, b) for a, b in zip(once[0], each[0]))
    assert np.allclose(once[1], each[1], rtol=1e-4, atol=1e-2) and np.allclose(once[2], each[2], rtol=1e-4, atol=1e-2)


def test_decisions_of_tokens_with_the_same_before_them_are_made_once():
    rng = np.random.default_rng(5)
    tree = mixing.huffman([int(x) for x in rng.integers(1, 900, 300)])
    text = rng.integers(0, 300, 120)
    sizes = np.array([120] * 40 + [1, 7, 40])
    ids = np.concatenate([text] * 40 + [text[:1], text[:7], rng.integers(0, 300, 40)])
    tables = [300, mixing.SLOTS, mixing.SLOTS, mixing.SLOTS]
    b = mixing.tree_bits(ids, sizes, tree)
    once, each = sums(mixing.tree_groups(ids, sizes, tree), tables), sums([(b.bit, b.cells)], tables)
    same(once, each)
    assert 20 * once[3] < each[3]


def test_largest_ids_keep_their_own_groups():
    """Ids at the ends of their ranges, which are packed into one number."""
    tree = mixing.huffman([1] * (mixing.TREE_WORDS + 2))
    edge = np.array([0, 1, 2, mixing.END + mixing.COMMON - 1, mixing.END + mixing.COMMON, mixing.TREE_WORDS, mixing.TREE_WORDS + 1])
    ids = np.random.default_rng(6).choice(edge, 3000)
    sizes, tables = np.array([1000, 1, 1999]), [mixing.TREE_WORDS + 2, mixing.SLOTS, mixing.SLOTS, mixing.SLOTS]
    b = mixing.tree_bits(ids, sizes, tree)
    same(sums(mixing.tree_groups(ids, sizes, tree), tables), sums([(b.bit, b.cells)], tables))


def test_equal_bytes_with_the_same_before_them_are_spelled_once():
    words = [a + b + c for a in (b"ab", b"", b"x\xc3\xa4", b"\xff") for b in (b"tion", b"er", b"") for c in (b"s", b"lichkeit", b"") if a + b + c] * 3
    tables = [mixing.SLOTS] * len(mixing.ORDERS)
    once, each = sums(mixing.spelling_groups(words), tables), sums(mixing.spelling_steps(words), tables)
    same(once, each)
    assert 3 * once[3] < each[3]
    model, total = mixing.fitted(once[0], mixing.spelling_steps(words)), 0
    for bit, cells in mixing.spelling_steps(words):
        odds, gate = mixing._inputs(model, cells)
        total = total + mixing._cost(sum(w[gate] * x for w, x in zip(model["weights"], odds)), bit)
    ends = np.cumsum([len(w) + 1 for w in words])
    want = [total[end - len(w) - 1:end].sum() / np.log(10) for w, end in zip(words, ends)]
    assert mixing.spelled(words, model) == pytest.approx(want, rel=1e-5)


def test_weights_move_only_in_texts_that_go_on(monkeypatch):
    tree, rng = mixing.huffman([5, 1, 9, 2, 2]), np.random.default_rng(7)
    sizes = np.array([3] * 50 + [200])
    ids = rng.integers(0, 5, sizes.sum())
    b, counts = mixing.tree_bits(ids, sizes, tree), mixing.Counts([5, mixing.SLOTS, mixing.SLOTS, mixing.SLOTS])
    counts.add(b.bit, b.cells)
    model, sums_over, count = mixing.fitted(counts.cells, [(b.bit, b.cells)]), [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, weights=None, minlength=0: sums_over.append(minlength) or count(x, weights, minlength))
    mixing.scored(ids, sizes, tree, model)
    assert max(sums_over) == mixing.GATES and sums_over.count(len(sizes)) == 1


def test_words_are_cut_as_bytes_are():
    texts = [None, b"", b"  ", b"A b\x0bC\x0c\r\n d", b" x\xc2\xa0y \xe2\x80\x83Z", b"\xff\x00Q \x1c \x85", "ÄB ä".encode(), b"one"]
    for at in range(len(texts)):
        words, sizes = mixing._flat_words(pa.array(texts, pa.binary()).slice(at))
        want = [(t or b"").lower().split() for t in texts[at:]]
        assert words.view(pa.binary()).to_pylist() == [w for own in want for w in own]
        assert sizes.tolist() == [len(own) for own in want]


def test_slices_hold_all_rows_and_few_bytes(monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_arrays([pa.array([b"1234", None, b"123456", b"x" * 50, b"", b"y" * 11, b"z"], pa.binary())], ["text"])
    found = [s.column(0).to_pylist() for s in mixing._slices(batch, 0)]
    assert sum(found, []) == batch.column(0).to_pylist()
    assert all(len(own) == 1 or sum(len(t or b"") for t in own) <= 10 for own in found) and len(found) == 5
