"""The pipeline's stages beside brute force, on the smallest tables."""

import sentencepiece

import corpus_pipeline
from siftwell.llm import quality, queries

from . import brute
from .test_stage_near_duplicates import stays

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tables):
    docs = {r["doc_id"]: r["text"] for r in tables["documents"].collect()}
    items = [(r["item_id"], r["text"]) for r in tables["benchmark"].collect()]
    kept = {}
    for i, t in docs.items():
        words, chars, symbols, repeated, covered = brute.quality(t)
        lines = sum(bool(brute.WORD.search(x)) for x in t.split("\n"))
        bad = (words < 50 or 100 * covered > 50 * words or symbols > words or lines >= 4 and 10 * repeated > 7 * lines
               or chars < 2 * words or chars > 40 * words)
        if not bad:
            kept[i] = t
    assert quality.keep(tables["documents"]).count() == len(kept)
    left = set(stays(sorted(kept.items())))
    left = {i for i in left if not brute.contamination(kept[i], items)[1]}
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(found) == left
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    for i in left:
        if brute.secrets(kept[i]):
            assert not brute.secrets(library.decode(list(found[i]["ids"])))
        else:
            assert list(found[i]["ids"]) == library.encode(kept[i])


def test_stages_hand_on_the_documents_columns(spark, tables):
    docs = tables["documents"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == tables["documents"].columns


def test_queries_are_registered():
    import __spark_entry__ as contract
    names = set(contract.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {q.split("_")[0] + "_" for q in names if q.startswith("op") and q[2].isdigit()}
    assert "pipeline" in names
