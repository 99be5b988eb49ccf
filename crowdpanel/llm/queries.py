"""One query per operator, over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_blocks, line_dedup, mil, minhash, phrases, pieces, rules, secrets, suffix_dedup, toxicity, trie, warc
from .common import stored, table

#: A-Z alone are lower-cased, in both engines.
_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    rows = pieces.encode_and_decode(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def fold(mod: int, held: int) -> Column:
    """True for the rows that learning never sees."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == held


def op3_quality_mil(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = mil.train(docs, table(spark, folder, "labels").where(~fold(3, 1)))
    return mil.scored(docs, model).select("doc_id", F.coalesce(fold(3, 1), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                                          "n_passages", "top_passage")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels").where(~fold(4, 2)))
    return toxicity.scored(docs, model).select("doc_id", F.coalesce(fold(4, 2), F.lit(False)).alias("held_out"), "score",
                                               (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_restored")


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = stored(secrets.findings(docs, secrets.letter_costs(docs), secrets.common_words(docs)))
    labelled = found.withColumn("label", secrets.weak_label()).where("label is not null")
    return secrets.judged(found, labelled).select("doc_id", "start", "end", "candidate", "before", "after", "score", "is_secret")


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    place = warc.new_folder(spark)
    manifest = warc.write_archives(table(spark, folder, "pages"), place)
    found = warc.resolved(warc.read_archives(manifest, place))
    return found.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", F.col("full_digest").alias("payload_digest"), "record_type",
                        F.col("refers_to").cast("long").alias("refers_to"))


OP4 = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS body FROM pages),
h AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM r
"""


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return rules.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_BIN = "(greatest(length(bin(v)) - 6, 0) * 32 + (v >> greatest(length(bin(v)) - 6, 0)))"
_LOW = "((b - greatest(b // 32 - 1, 0) * 32) << greatest(b // 32 - 1, 0))"
OP5 = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '{_SPACED}'), []) AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM d, unnest(range(1, len(w) - 6)) u(i)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win), unnest(range(i, i + 8)) u(p)
        WHERE c > 1 GROUP BY doc_id),
m AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
v AS (SELECT doc_id, lang, source, base_failed, u.measure, u.v FROM b, unnest([
      {{'measure': 'symbols', 'v': 1000 * n_symbols // greatest(n_words, 1)}}, {{'measure': 'chars', 'v': 1000 * word_chars // greatest(n_words, 1)}},
      {{'measure': 'dup_lines', 'v': 1000 * n_dup_lines // greatest(n_words, 1)}}, {{'measure': 'repeats', 'v': 1000 * n_repeat_words // greatest(n_words, 1)}}]) t(u)),
s AS (SELECT lang, source, measure, {_BIN} AS b, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
lev AS (SELECT 0 AS lev, lang, source, measure, b, n FROM s
        UNION ALL SELECT 1, lang, NULL, measure, b, sum(n) FROM s GROUP BY lang, measure, b
        UNION ALL SELECT 2, NULL, NULL, measure, b, sum(n) FROM s GROUP BY measure, b),
run AS (SELECT *, sum(n) OVER (PARTITION BY lev, lang, source, measure ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lev, lang, source, measure) AS rows_ FROM lev),
qb AS (SELECT lev, lang, source, measure, max(rows_) AS rows_, min(b) FILTER (100 * upto >= 25 * rows_) AS b1, min(b) FILTER (100 * upto >= 75 * rows_) AS b3
       FROM run GROUP BY ALL),
q AS (SELECT lev, lang, source, measure, rows_, (SELECT {_LOW} FROM (SELECT b1 AS b)) AS q1, (SELECT {_LOW} FROM (SELECT b3 AS b)) AS q3 FROM qb),
p AS (SELECT g.lang, g.source, g.measure, CASE WHEN g.rows_ >= 100 THEN g.q1 WHEN l.rows_ >= 100 THEN l.q1 ELSE a.q1 END AS q1,
      CASE WHEN g.rows_ >= 100 THEN g.q3 WHEN l.rows_ >= 100 THEN l.q3 ELSE a.q3 END AS q3
      FROM q g JOIN q l ON l.lev = 1 AND l.measure = g.measure AND l.lang IS NOT DISTINCT FROM g.lang JOIN q a ON a.lev = 2 AND a.measure = g.measure WHERE g.lev = 0),
f AS (SELECT lang, source, measure, q3 + 3 * greatest(q3 - q1, CASE measure WHEN 'chars' THEN 500 WHEN 'repeats' THEN 50 ELSE 20 END) AS high,
      CASE measure WHEN 'chars' THEN q1 - 3 * greatest(q3 - q1, 500) ELSE -1 END AS low FROM p),
bad AS (SELECT DISTINCT doc_id FROM v JOIN f ON v.measure = f.measure AND v.lang IS NOT DISTINCT FROM f.lang AND v.source IS NOT DISTINCT FROM f.source
        WHERE v.v > f.high OR v.v < f.low)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM b LEFT JOIN bad USING (doc_id)
"""


def op8_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), num=85, den=100)


OP8 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLD}, '{_SPACED}'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
joint AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM joint JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON r = link.a),
least_ AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN least_ USING (doc_id)
"""


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    judged = decontam.contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                         F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"))


OP9 = rf"""
WITH it AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, '{_LETTERS}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k
        FROM it, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLD}, '{_LETTERS}'), []) AS w FROM documents),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM d, (SELECT DISTINCT n FROM win) z, unnest(range(1, len(w) - n + 2)) t(i)),
hit AS (SELECT doc_id, item, i, n FROM pos JOIN win USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"), least=30, longest=4, absorb=80, first=2000)


OP11 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_FOLD}, '[.,;:!?\x0A-\x0D]')) AS s FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
z AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM w),
o AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM z),
g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*)::HUGEINT AS f FROM o GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, g, f, string_split(g, ' ') AS w FROM g WHERE k >= 2 AND f >= 30),
parts AS (SELECT lang, g, f AS a, k, w, unnest(range(1, k)) AS j FROM c),
sides AS MATERIALIZED (SELECT lang, g, a, j, array_to_string(w[1:j], ' ') AS gl, array_to_string(w[j + 1:k], ' ') AS gr FROM parts),
cut AS (SELECT sides.*, x.f AS l, y.f AS r, 2000000 * a // (x.f + y.f) AS score FROM sides JOIN g x ON x.lang = sides.lang AND x.g = gl JOIN g y ON y.lang = sides.lang AND y.g = gr),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
len_ AS (SELECT lang, f, k, w, unnest(range(2, k)) AS d FROM c),
at_ AS (SELECT lang, f, w, d, unnest(range(1, k - d + 2)) AS s FROM len_),
sub AS (SELECT lang, array_to_string(w[s:s + d - 1], ' ') AS g, max(f) AS f FROM at_ GROUP BY ALL),
fit AS (SELECT low.* FROM low LEFT JOIN sub USING (lang, g) WHERE NOT coalesce(100 * sub.f >= 80 * low.a, false)),
t AS (SELECT lang, g AS phrase, a, l, r, score FROM fit)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
       CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM t JOIN n USING (lang) QUALIFY rank <= 2000
"""


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    convs, turns = trie.rebuilt(trie.paths(table(spark, folder, "conversations")), block=20, kinds=4)
    return trie.prefix_nodes(convs, turns)


_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda v, x:
      list_reduce(list_prepend(xor(v, x), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""
OP12 = rf"""
WITH t AS (SELECT conv_id AS c, turn, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
l AS MATERIALIZED (SELECT c, list(x ORDER BY turn NULLS FIRST, x.r, x.t) AS w FROM t GROUP BY c),
h AS MATERIALIZED (SELECT c, w, {_CRC32} % 4 AS h FROM l),
r AS MATERIALIZED (SELECT h.c, coalesce(b.w[1:h.h], []) || h.w[h.h + 1:] AS w FROM h LEFT JOIN l b ON b.c = h.c - h.c % 20),
steps AS (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM r),
node AS MATERIALIZED (SELECT d, w[1:d] AS p, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(w) = d) AS ends FROM steps GROUP BY ALL),
kids AS MATERIALIZED (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
own AS MATERIALIZED (SELECT node.*, coalesce(kids.n, 0) AS n_children,
        CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[d].t, '{_SPACED}')) END AS saved FROM node LEFT JOIN kids USING (d, p)),
up AS (SELECT p, n_children, saved, unnest(range(0, d + 1)) AS d FROM own),
below AS MATERIALIZED (SELECT d, p[1:d] AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY ALL)
SELECT own.conv_id, own.d AS depth, above.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN below USING (d, p) LEFT JOIN node above ON above.d = own.d - 1 AND above.p = own.p[1:own.d - 1]
"""


def op13_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_blocks.main_text(table(spark, folder, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_quality_mil": op3_quality_mil,
    "op4_warc": op4_warc,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_secrets": op7_secrets,
    "op8_minhash": op8_minhash,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_phrases": op11_phrases,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_html_text": op13_html_text,
}
ORACLES = {"op4_warc": OP4, "op5_quality_rules": OP5, "op8_minhash": OP8, "op9_decontamination": OP9, "op11_phrases": OP11, "op12_prefix_trie": OP12}
