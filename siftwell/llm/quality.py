"""Quality rules as a ledger: every rule once, a bit for each failure, versioned policies over the bits.

``ledger`` measures each document once and stores which rules it fails as bits
of one long. What a policy keeps is then a mask over that long, so policies
can be changed, compared and ablated without reading a text again.

Everything is a Spark expression over one row: no shuffle, no Python. Repeated
windows are found by sorting 64-bit numbers that hold a window's hash above
its place, so equal windows become neighbours; the words themselves are then
compared, so a clash of hashes is not taken for a repeat.

Defined results: a null text has no words, an empty one neither, and both fail
``few_words``. Rows are judged one by one, so repeated rows and null ids are
kept as they are; an empty table gives an empty ledger. Extra columns are left
out of the ledger, and ``keep`` hands all of them through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, word_list

SYMBOLS = "[#*$%&|<>]"
HAS_WORD = r"[^\x20\x09-\x0D]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` is SQL over the measures; ``bit`` never changes once given out."""
    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 AND 10 * n_dup_lines > 7 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 40 * n_words"),
    Rule(6, "strict_symbols", "10 * n_symbols > n_words"),
    Rule(7, "strict_repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
)

#: A policy is a list of rules; a version once published is not edited.
POLICIES = {
    "v1": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "short_words", "long_words"),
    "strict": tuple(r.name for r in RULES),
}
CURRENT = "v2"


def mask(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def _window_numbers(words, bits) -> Column:
    """One long for each 3-word window: its hash above, its place in the low ``bits``."""
    return F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.coalesce(F.call_function("shiftleft", F.xxhash64(
            F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(i.cast("long")), F.lit(0)))


def _repeated(words) -> Column:
    """How many words stand in 3-word windows that occur twice or more."""
    def in_sorted(bits, numbers):
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def place(x):
            return x.bitwiseAND(low).cast("int")

        def same(x, y):
            alike = F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
            for k in range(3):
                alike = alike & (F.get(words, place(x) + k) == F.get(words, place(y) + k))
            return F.coalesce(alike, F.lit(False))

        twice = F.filter(numbers, lambda x, i: same(x, F.get(numbers, i + 1)) | same(x, F.get(numbers, i - 1)))
        return let(F.sort_array(F.transform(twice, place)), covered)

    def covered(places):
        # A window covers three words, or fewer up to where the next one starts.
        return F.aggregate(
            F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))),
            F.lit(0).cast("long"), lambda a, b: a + b)

    bits = F.length(F.bin(F.size(words).cast("long")))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        let(bits, lambda b: let(F.sort_array(_window_numbers(words, b)), lambda s: in_sorted(b, s))))


def _lines(text: Column) -> Column:
    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD)),
               lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                  (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def measures(text: Column) -> Column:
    """One struct with every measurement of a text."""
    text = F.coalesce(text, F.lit(""))
    by_word = let(word_list(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeated(w).alias("n_repeat_words")))
    return let(F.struct(by_word.alias("w"), _lines(text).alias("l"),
                        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols")),
               lambda m: F.struct(m["w"]["n_words"].alias("n_words"), m["w"]["word_chars"].alias("word_chars"),
                                  m["n_symbols"].alias("n_symbols"), m["l"]["n_lines"].alias("n_lines"),
                                  m["l"]["n_dup_lines"].alias("n_dup_lines"),
                                  m["w"]["n_repeat_words"].alias("n_repeat_words")))


def failures() -> Column:
    """The rules a row of measures fails, as bits of a long."""
    found = F.lit(0).cast("long")
    for rule in RULES:
        found = found.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return found


def ledger(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, every measure, failures): the store that policies are applied to."""
    found = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), measures(docs[f"`{text}`"]).alias("m"))
    return found.select("doc_id", "m.*").withColumn("failures", failures())


def verdicts(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` under a policy."""
    return entries.withColumn("kept", F.col("failures").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, failed, only, kept_without) for each rule of a policy.

    ``failed`` documents break the rule, ``only`` break it and no other rule of
    the policy, ``kept_without`` would be kept if the rule were left out. The
    ledger is first summed to a count for each pattern of bits, at most two to
    the number of rules, so the shuffle does not grow with the documents.
    """
    whole = mask(policy)
    patterns = entries.select(F.col("failures").bitwiseAND(F.lit(whole)).alias("bits")).groupBy("bits").count()
    named = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
             for r in RULES if r.name in POLICIES[policy]]
    each = patterns.select("bits", "count", F.explode(F.array(*named)).alias("r")).select("bits", "count", "r.*")

    def total(condition):
        return F.sum(F.when(condition, F.col("count")).otherwise(F.lit(0))).cast("long")

    return each.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(F.col("bits") == F.col("bit")).alias("only"),
        total(F.col("bits").bitwiseAND(F.lit(whole).bitwiseXOR(F.col("bit"))) == 0).alias("kept_without"))


def keep(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The documents a policy keeps, with all their columns."""
    name = "__m"
    while name in docs.columns:
        name += "_"
    entries = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(name),
                          measures(docs[f"`{text}`"]).alias("m")).select(name, "m.*")
    return verdicts(entries.withColumn("failures", failures()), policy).where("kept").select(f"{name}.*")
