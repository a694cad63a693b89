"""SQL twins for DuckDB, written from the contracts and not from the operators."""

from . import licences, quality

# Lower-cases A-Z alone, as the contracts ask.
_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BENCH_WORDS = "regexp_extract_all(" + _AZ.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


# A line that states a copyright, and one that begins so but goes on as prose of a licence.
_STATES = (r"^[\x20\t\r#*/;-]*([cC][oO][pP][yY][rR][iI][gG][hH][tT][\x20\t:]+(\([cC]\)|©|[bB][yY][\x20\t]|[0-9]|\p{Lu}\p{Ll}|[<\[{])"
           r"|\([cC]\)[\x20\t]*([0-9]|[<\[{©])|©)")
_PROSE = r"^[\x20\t\r#*/;-]*[cC][a-zA-Z]*[\x20\t:]+(Holder|Owner|Notice|Licence|License|Law|Statement)"
_RESERVED = r"(?i)^[\x20\t\r#*/;-]*all rights reserved\.?[\x20\t\r]*$"
_SPELLINGS = ((r"\blicence", "license"), (r"\bsub licens", "sublicens"), (r"\bnon (infring|commercial|exclusive)", r"non\1"),
              (r"\bmerchantibility\b", "merchantability"), (r"\bcopyright (holders|owners?)\b", "copyright holder"),
              (r"\bwhilst\b", "while"), (r"\b(?:ver|v) ?(\d)", r"version \1"), (r"\bhttps? (?:www )?", "url "))


def _canonical(text: str) -> str:
    lines = (f"[x FOR x IN string_split({text}, chr(10)) IF NOT (regexp_matches(x, '{_RESERVED}') OR "
             f"(regexp_matches(x, '{_STATES}') AND NOT regexp_matches(x, '{_PROSE}')))]")
    text = rf"regexp_replace(lower(array_to_string({lines}, chr(10))), '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    for pattern, new in _SPELLINGS:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return f"trim({text}, ' ')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP4 = f"""
WITH known AS (SELECT DISTINCT licence, sha256({_canonical('t')}) AS digest
  FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in licences.CATALOGUE)}) AS v(licence, t)
  UNION VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in licences.DIGESTS)}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, sha256({_canonical('line')}) AS digest FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{licences.HINT}')),
n AS (SELECT r, count(*) AS n, string_agg(DISTINCT licence, ',' ORDER BY licence) AS names FROM l JOIN known USING (digest) GROUP BY r),
w AS (SELECT *, sha256({_canonical('text')}) AS text_sha256 FROM d)
SELECT doc_id, text_sha256, licence, coalesce(names, '') AS notices, coalesce(n, 0) AS n_notices
FROM w LEFT JOIN known ON text_sha256 = digest LEFT JOIN n USING (r)"""

OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_BENCH_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_BENCH_WORDS} AS w FROM benchmark),
size AS (SELECT DISTINCT least(10, len(w)) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, list_slice(w, p, p + least(10, len(w)) - 1) AS words
  FROM i, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p) WHERE len(w) > 0),
dw AS (SELECT r, p, n, list_slice(w, p, p + n - 1) AS words
  FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, size WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, p, n, item FROM dw JOIN win USING (words)),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hit)) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN items USING (r)"""

OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, p, list_slice(w, p, p + 34) AS words FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d)),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY words) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT r, q FROM (SELECT r, unnest(range(p, p + 35)) AS q FROM rep)),
each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY q) AS text, count(*) AS n FROM each ANTI JOIN gone USING (r, q) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""

# The template's marks and escapes, as text.
_ESCAPED = r"replace(replace({0}, '\', '\b'), '<', '\l')"

OP9 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, lag(role) OVER s IS NOT DISTINCT FROM role AS joined,
    length({_ESCAPED.format('text')}) AS chars FROM t
  WINDOW s AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN joined THEN 3 ELSE 3 + length(role) + 8 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id"""

_FAILED = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality.RULES)

OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT r, [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
win AS (SELECT r, p, w[p:p + 2] AS words FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
rep AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, words) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words
  FROM d JOIN l USING (r) LEFT JOIN cov USING (r)),
f AS (SELECT *, CAST({_FAILED} AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  (failures & {quality.mask(quality.CURRENT)}) = 0 AS kept, failures FROM f"""


# Bit by bit, over the digits of a whole number.
_CRC32 = """(xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ascii(substr({0}, i, 1)) AS BIGINT) FOR i IN range(1, length({0}) + 1)]),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]),
    lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))))"""

OP11 = f"""
WITH o AS (SELECT conv_id AS c, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS s,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT c, list(s ORDER BY p) AS own, {_CRC32.format("CAST(c AS VARCHAR)")} % 6 AS h FROM o GROUP BY c),
q AS MATERIALIZED (SELECT g.c, list_concat(coalesce(b.own[1:g.h], []), g.own[g.h + 1:]) AS s FROM g LEFT JOIN g AS b ON b.c = g.c - g.c % 100),
m AS MATERIALIZED (SELECT *, min(c) OVER (PARTITION BY d, prefix) AS v FROM (SELECT c, len(s) AS n, d, s[1:d] AS prefix, s[d].t AS last
  FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM q))),
n AS (SELECT d, v, count(*) AS n_convs, (count(*) - 1) * coalesce(length(any_value(last)), 0) AS w,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM m GROUP BY d, v),
p AS (SELECT DISTINCT a.d, a.v, b.v AS up FROM m AS a JOIN m AS b ON a.c = b.c AND b.d = a.d - 1),
k AS (SELECT d - 1 AS d, up AS v, count(*) AS n_children FROM p GROUP BY d, up),
below AS (SELECT DISTINCT a.d, a.v, b.d AS bd, b.v AS bv FROM m AS a JOIN m AS b ON a.c = b.c AND b.d >= a.d),
sums AS (SELECT below.d, below.v, count(*) FILTER (k.v IS NULL) AS n_leaves, CAST(sum(w) AS BIGINT) AS saved_tokens
  FROM below JOIN n ON n.d = bd AND n.v = bv LEFT JOIN k ON k.d = bd AND k.v = bv GROUP BY below.d, below.v)
SELECT v AS conv_id, n.d AS depth, up AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends AS ends_sha256
FROM n JOIN sums USING (d, v) LEFT JOIN p USING (d, v) LEFT JOIN k USING (d, v)"""


OP12 = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, w FROM (
  SELECT doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents)),
s AS MATERIALIZED (SELECT DISTINCT r, CASE WHEN len(w) < 3 THEN w ELSE w[p:p + 2] END AS shingle
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s AS x JOIN s AS y ON x.shingle = y.shingle GROUP BY x.r, y.r)
  JOIN n AS na ON na.r = a JOIN n AS nb ON nb.r = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, b FROM reach JOIN links ON a = t),
m AS (SELECT reach.r, min(t.doc_id) AS component_id FROM reach JOIN d AS t ON t.r = reach.t GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN m USING (r) LEFT JOIN n USING (r)"""


def _op13() -> str:
    """Rounds written out: distances to every entry, then the floor of each entry's mean."""
    steps = ["""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding, label NULLS LAST) - 1 AS r, vec_id, label, embedding
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
e AS MATERIALIZED (SELECT r, p, j, CAST(floor(256 * CAST(embedding[p * (len(embedding) // 16) + j + 1] AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT *, unnest(range(len(embedding) // 16)) AS j FROM k), (SELECT unnest(range(16)) AS p)),
b0 AS MATERIALIZED (SELECT r AS c, p, j, x AS v FROM e WHERE r < 64)"""]
    for i in range(3):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, p, min(d * 64 + c) AS m FROM (
  SELECT r, p, c, sum((x - v) * (x - v)) AS d FROM e JOIN b{i} USING (p, j) GROUP BY r, p, c) GROUP BY r, p)""")
        if i < 2:
            steps.append(f"""b{i + 1} AS MATERIALIZED (SELECT c, p, j, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), v) AS v FROM b{i} LEFT JOIN (
  SELECT m % 64 AS c, p, j, sum(x) AS s, count(*) AS n FROM e JOIN a{i} USING (r, p) GROUP BY m % 64, p, j) USING (c, p, j))""")
    return ",\n".join(steps) + """,
f AS (SELECT r, string_agg(lower(printf('%02x', CAST(m % 64 AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, c, j)) FROM b2) AS codebooks_sha256
FROM f JOIN k USING (r)"""


OP13 = _op13()
