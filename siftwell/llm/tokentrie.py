"""Token counts by dynamic programming over a trie of the distinct pre-tokens.

A text's pre-tokens are its words, each with the model's word mark in front.
The best segmentation of a pre-token is the one whose pieces have the greatest
sum of scores (then the fewest pieces). That sum for a prefix does not depend
on what follows, so the distinct pre-tokens of a batch are walked as a trie, in
sorted order: each node's forward score is worked out once for all pre-tokens
below it, and the count at a terminal node is stored for every later use.

A character that no piece covers costs one piece for each of its UTF-8 bytes
and ``UNKNOWN`` below the least score of an ordinary piece.

Texts stay where they lie; nothing is shuffled. A task keeps up to
``MOST_KEPT`` counts and then starts anew, which changes no result.

Defined results: a null or empty text has no pre-tokens and no tokens. Rows are
independent, so ties, repeated rows, null ids and empty tables need no rule.
Extra columns are carried in a struct and clash with nothing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import packed, texts_in, with_results, words_of

MARK = "▁"
UNKNOWN = -10.0
#: Pieces below this are in the file but never used by its own model.
LEAST_SCORE = -1e8
MOST_KEPT = 500_000
BATCH_ROWS = 1024


def piece_scores(model_path: str) -> dict[str, float]:
    """The ordinary pieces of a model file and their scores."""
    from sentencepiece import sentencepiece_model_pb2 as files

    described = files.ModelProto()
    with open(model_path, "rb") as f:
        described.ParseFromString(f.read())
    return {p.piece: p.score for p in described.pieces if p.type == p.NORMAL and p.score > LEAST_SCORE}


class Trie:
    """Counts and scores of pre-tokens; ``add`` walks new ones with their prefixes shared."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.lead = min(scores.values(), default=0.0) + UNKNOWN
        self.terminal: dict[bytes, tuple[int, float]] = {}

    def add(self, words) -> None:
        """Store the terminal values of some words (UTF-8, without the mark)."""
        scores, longest = self.scores, self.longest
        best, pieces, past = [0.0], [0], ""
        for word in sorted({(MARK + w.decode("utf-8", "replace"), w) for w in words}):
            text, raw = word
            shared = 0
            for a, b in zip(text, past):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], pieces[shared + 1:]
            for end in range(shared + 1, len(text) + 1):
                # What no piece covers: the character alone, byte by byte.
                top, fewest = best[end - 1] + self.lead, pieces[end - 1] + len(text[end - 1].encode())
                for start in range(max(0, end - longest), end):
                    score = scores.get(text[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and pieces[start] + 1 < fewest:
                            top, fewest = score, pieces[start] + 1
                best.append(top)
                pieces.append(fewest)
            past = text
            self.terminal[raw] = pieces[-1], best[-1]

    def totals(self, texts: list[bytes | None]) -> list[tuple[int, int, float]]:
        """(pre-tokens, tokens, score) of each text."""
        split = [words_of(t) for t in texts]
        if len(self.terminal) > MOST_KEPT:
            self.terminal.clear()
        self.add({w for words in split for w in words}.difference(self.terminal))
        out = []
        for words in split:
            found = [self.terminal[w] for w in words]
            out.append((len(words), sum(f[0] for f in found), float(sum(f[1] for f in found))))
        return out


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(__row, n_pretokens, n_tokens, score): each document (or its columns ``carry``) as a struct, with its counts."""
    rows = packed(docs, text, carry)
    fields = [T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType()),
              T.StructField("score", T.DoubleType())]

    def run(batches):
        trie = Trie(piece_scores(model_path))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                counts, tokens, scores = zip(*trie.totals(texts_in(part)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.array(tokens, pa.int64()), pa.array(scores, pa.float64())],
                    names=["__row", "n_pretokens", "n_tokens", "score"])

    return rows.mapInArrow(run, with_results(rows, fields))
