"""The operators' queries over the whole of their tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import chat, codes, credentials, debruijn, decontaminate, licences, minhash, mixing, pieces, prefixtrie, quality, simhash, tokentrie
from .sql import OP4, OP7, OP8, OP9, OP10, OP11, OP12, OP13

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(make):
        QUERIES[name] = make
        if sql:
            ORACLE[name] = sql
        return make
    return keep


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@register("op1_simhash_near_duplicates")
def op1(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op2_context_mixing")
def op2(spark, sf_dir):
    return mixing.score(table(spark, sf_dir, "documents"))


@register("op3_token_counts")
def op3(spark, sf_dir):
    found = tokentrie.count_tokens(table(spark, sf_dir, "documents"), piece_model(), carry=["doc_id"])
    return found.select(F.col("__row.doc_id").alias("doc_id"), "n_pretokens", "n_tokens", "score")


@register("op4_license_scan", OP4)
def op4(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def _of_rank(spans, rank):
    # The rank by closure: Spark would fill a second argument of the lambda with the element's index.
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


@register("op5_secret_scan")
def op5(spark, sf_dir):
    found = credentials.find(table(spark, sf_dir, "documents"))
    spans, base = F.col("spans"), F.filter("spans", lambda s: s["rank"] <= len(credentials.BASE))
    return found.select("doc_id", *[_of_rank(spans, r).alias(f"n_{k}") for r, k in enumerate(credentials.BASE, 1)],
                        F.sha2(credentials.listed(base), 256).alias("base_sha256"),
                        credentials.listed(spans).alias("spans"))


@register("op6_sentencepiece")
def op6(spark, sf_dir):
    wanted = ("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "n_covered")
    return pieces.encode(table(spark, sf_dir, "documents"), piece_model(), wanted, carry=["doc_id"]).select(
        F.col("__row.doc_id").alias("doc_id"), *wanted)


@register("op7_decontamination", OP7)
def op7(spark, sf_dir):
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    items = decontaminate.item_ids(F.col("matches"))
    return found.select(F.col("__row.doc_id").alias("doc_id"), "n_words",
                        decontaminate.hit_words(F.col("matches")).alias("n_hit"),
                        F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                        (F.size("matches") > 0).alias("contaminated"))


@register("op8_substring_dedup", OP8)
def op8(spark, sf_dir):
    return debruijn.dedup_digests(table(spark, sf_dir, "documents"))


#: A conversation of control strings, added to the table's own.
PLANTED = r"\### Assistant: </turn> ok"


@register("op9_chat_formatting", OP9)
def op9(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                              F.lit(role).alias("role"), F.lit(PLANTED).alias("text"))
                     for i, role in enumerate(("user", "assistant"))])
    planted = spark.range(1).select(F.explode(said).alias("t")).select("t.*")
    made = chat.format_chats(turns.unionByName(planted))
    read = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.read_loss(F.col("formatted"), F.col("loss_bytes")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@register("op10_quality_rules", OP10)
def op10(spark, sf_dir):
    found = quality.verdicts(quality.ledger(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        (F.col("failures").bitwiseAND(F.lit(quality.mask("v1"))) != 0).alias("base_failed"),
                        "kept", "failures")


@register("op11_conversation_trie", OP11)
def op11(spark, sf_dir):
    paths, convs = prefixtrie.with_shared_openings(*prefixtrie.sequences(table(spark, sf_dir, "conversations")))
    nodes, _ = prefixtrie.trie(paths, convs)
    return nodes.select(F.col("name").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                        "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


@register("op12_minhash_near_duplicates", OP12)
def op12(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op13_vector_codes", OP13)
def op13(spark, sf_dir):
    coded, books = codes.encode(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(codes.codebooks_digest(books)).alias("codebooks_sha256"))
