"""Secrets in texts, and credentials whose parts only together give them away.

Strong finds (kinds ``assign``, ``access``, ``hex``) count alone. Weak
candidates are parts of a credential that are common in harmless text: a user
or client name, a mixed token, an endpoint. A weak part is reported only where
a complementary part lies within ``SCOPE`` characters of it in the same
document: a name beside a secret, a token beside an identifier, an endpoint
beside both. Strong finds serve as partners too: ``access`` as an identifier,
``assign`` and ``hex`` as secrets.

The interval join runs as a sweep over the parts of a document in order of
place: for each part the furthest end before it and the nearest start after it
are kept for each role, so every partner within reach is seen and no pairs are
made. All of it is Spark expressions; places come from the lengths of what
regular expressions find and of the gaps between.

Defined results: null is empty. Rows with the same id and text share their
finds, each row keeping its own line in the result. Places are code points,
ends exclusive. Texts of any length are read whole; work grows with the parts of
a text, not with their pairs. Equal places are ordered by kind. Extra columns are left out of ``find`` and handed through by
``redact``. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.session import written

from .common import text_key

SCOPE = 200
REDACTED = "[SECRET]"
BASE = ("assign", "access", "hex")
#: kind: (pattern, least length of its measured group, that group, role, weak)
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
               6, 3, "secret", False),
    "access": (r"(AKIA[A-Z0-9]{16,})", 20, 2, "identifier", False),
    "hex": (r"([0-9a-f]{24,})", 24, 2, "secret", False),
    "name": (r"""((?i:user(?:name)?|login|account|client_?id|access_?(?:key_?)?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+))""",
             3, 3, "identifier", True),
    "token": (r"((?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,})", 16, 2, "secret", True),
    "endpoint": (r"""(https?://[^\s"'<>]+)""", 10, 2, "endpoint", True),
}
#: What quickly rules a text out, where a kind's own pattern would be slow.
HINTS = {"access": "AKIA", "hex": "[0-9a-f]{24}", "token": "[A-Za-z0-9+/_-]{16}", "endpoint": "https?://"}


def kind_order() -> Column:
    return F.array(*[F.lit(k) for k in KINDS])


def _found(text: Column, kind: str) -> Column:
    """An array of (kind, n, gap and match length, match length, measured length) of one kind."""
    pattern, _, group, _, _ = KINDS[kind]
    # Each match starts where the last one ended, so a tail without one is read once.
    whole = F.lit(rf"\G(?s)(.*?){pattern}")

    def lengths(n):
        return F.transform(F.regexp_extract_all(text, whole, F.lit(n)), F.length)

    zipped = F.arrays_zip(lengths(0).alias("through"), lengths(2).alias("size"),
                          (lengths(group) if group > 2 else lengths(2)).alias("measured"))
    none = F.array().cast("array<struct<kind:string,n:int,through:int,size:int,measured:int>>")
    return F.when(text.rlike(HINTS.get(kind, pattern)), F.transform(zipped, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("n"), x["through"].alias("through"), x["size"].alias("size"),
        x["measured"].alias("measured")))).otherwise(none)


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text_key, found): one reading of the texts, written as it is used several times."""
    body = F.coalesce(docs[f"`{text}`"], F.lit(""))
    return written(docs.select(*text_key(docs, text, doc_id),
                               F.concat(*[_found(body, k) for k in KINDS]).alias("found")))


def parts(scanned: DataFrame) -> DataFrame:
    """(doc_id, text_key, kind, start, end) of every strong find and every weak candidate."""
    each = (scanned.where(F.size("found") > 0).dropDuplicates(["doc_id", "text_key"])
            .select("doc_id", "text_key", F.explode("found").alias("f")).select("doc_id", "text_key", "f.*"))
    so_far = Window.partitionBy("doc_id", "text_key", "kind").orderBy("n")
    placed = each.withColumn("end", F.sum("through").over(so_far)).withColumn("start", F.col("end") - F.col("size"))
    least = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v[1]))])
    return placed.where(F.col("measured") >= least[F.col("kind")]).select("doc_id", "text_key", "kind", "start", "end")


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The strong parts, and the weak ones that no strong one covers and that have their complement in scope."""
    role = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v[3]))])
    weak = ~F.col("kind").isin(*BASE)
    doc = ["doc_id", "text_key"]
    order = [F.col("start"), F.array_position(kind_order(), F.col("kind"))]
    before = Window.partitionBy(*doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # The same running sums from the other end: frames that reach forward would be worked out anew for each row.
    after = Window.partitionBy(*doc).orderBy(*[o.desc() for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({"role": role[F.col("kind")], "weak": weak})
    strong_end = F.when(~F.col("weak"), F.col("end"))
    strong_start = F.when(~F.col("weak"), F.col("start"))
    found = found.withColumns({"covered": F.col("weak") & (
        (F.coalesce(F.max(strong_end).over(before), F.lit(-1)) > F.col("start"))
        | (F.coalesce(F.min(strong_start).over(after), F.lit(1 << 60)) < F.col("end")))}).where(~F.col("covered"))

    def near(name):
        mine = F.col("role") == name
        return ((F.col("start") - F.max(F.when(mine, F.col("end"))).over(before) <= scope)
                | (F.min(F.when(mine, F.col("start"))).over(after) - F.col("end") <= scope))

    found = found.withColumns({"by_secret": F.coalesce(near("secret"), F.lit(False)),
                               "by_identifier": F.coalesce(near("identifier"), F.lit(False))})
    wanted = (F.when(F.col("role") == "identifier", F.col("by_secret"))
              .when(F.col("role") == "secret", F.col("by_identifier"))
              .otherwise(F.col("by_secret") & F.col("by_identifier")))
    return found.where(~F.col("weak") | wanted).select(*doc, "kind", "start", "end")


def listed(spans: Column) -> Column:
    """kind:start:end of an array of (start, place of the kind, end), comma-joined."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(kind_order(), s["rank"] - 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """(doc_id, spans), one row for each document; ``spans`` is a sorted array of (start, rank, end)."""
    scanned = scan(docs, text, doc_id)
    spans = link(parts(scanned), scope).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct(
        F.col("start").cast("long").alias("start"), F.array_position(kind_order(), F.col("kind")).cast("int").alias("rank"),
        F.col("end").cast("long").alias("end")))).alias("spans"))
    spans = spans.withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    return scanned.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_key").eqNullSafe(F.col("k")), "left").select(
        "doc_id", "text_key", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")).alias("spans"))


def _islands(spans: Column) -> Column:
    """Overlapping spans as one, in order."""
    kind = "array<struct<start:bigint,end:bigint>>"
    return F.aggregate(
        spans, F.array().cast(kind),
        lambda a, s: F.when((F.size(a) > 0) & (F.element_at(F.coalesce(a, F.array().cast(kind)), -1)["end"] > s["start"]),
                            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
                                F.element_at(a, -1)["start"].alias("start"),
                                F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(a, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))))


def blanked(text: Column, islands: Column, by: str = REDACTED) -> Column:
    """The text with each island replaced."""
    pieces = F.transform(islands, lambda s, i: F.concat(
        F.substring(text, (F.coalesce(F.get(islands, i - 1)["end"], F.lit(0)) + 1).cast("int"),
                    (s["start"] - F.coalesce(F.get(islands, i - 1)["end"], F.lit(0))).cast("int")), F.lit(by)))
    tail = F.substring(text, (F.element_at(islands, -1)["end"] + 1).cast("int"), F.length(text))
    return F.when(F.size(islands) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """Every document, with its secrets replaced by ``REDACTED``; other columns as they were."""
    spans = (find(docs, text, doc_id, scope).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
             .select(F.col("doc_id").alias("__d"), F.col("text_key").alias("__k"), _islands(F.col("spans")).alias("__s")))
    spans = written(spans)
    joined = docs.join(spans, docs[f"`{doc_id}`"].eqNullSafe(spans["__d"])
                       & (F.xxhash64(docs[f"`{text}`"]) == spans["__k"]), "left")
    clean = F.when(spans["__s"].isNull(), docs[f"`{text}`"]).otherwise(blanked(docs[f"`{text}`"], spans["__s"]))
    return joined.select(*[clean.alias(c) if c == text else docs[f"`{c}`"] for c in docs.columns])
