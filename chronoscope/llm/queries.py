"""The registered queries of this subpackage and their DuckDB SQL.

Each query reads its whole tables. A null text (or html) is an empty one, rows
that repeat are rows of their own unless an operator says otherwise, long texts
are taken whole, empty tables give no rows, and other columns of the tables are
not read; each operator's docstring has its own cases.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, licenses, neardup, quality, resample, spelling, substrings, tokencount, tokenfiles, toxicity, urlfilter, warc
from .shared import table

SQL: dict[str, str] = {}


def op8_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' words in windows of benchmark items; a text without words has no hits, repeated rows are marked each."""
    return decontaminate.digest(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


SQL["op8_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, ws[p : p + k - 1] AS win FROM (SELECT item_id, ws, least(13, len(ws)) AS k, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS p FROM i WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM iw),
dw AS (SELECT doc_id, p, k, ws[p : p + k - 1] AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks WHERE len(ws) >= k)),
h AS (SELECT doc_id, p, dw.k, item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op2_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of whole texts and what they decode to; an empty or null text has none, repeated rows are encoded each."""
    return bpe.digest(table(spark, sf, "documents"))


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Base counts and the verdict; empty and null texts fail, repeated rows are judged alike."""
    return quality.digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of whole texts; empty and null texts have none, repeated rows are counted each."""
    return tokencount.digest(table(spark, sf, "documents"))


def op10_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of shingle sets and components; empty and null texts are linked with nothing."""
    return neardup.digest(table(spark, sf, "documents"))


def op7_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of each text without windows that a smaller id has; empty and null texts stay empty."""
    return substrings.digest(table(spark, sf, "documents"))


SQL["op10_near_duplicates"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[p : p + 2] AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS p FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


SQL["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, p, ws[p : p + 12] AS win FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 12, 0) + 1)) AS p FROM d)),
f AS (SELECT win, min(doc_id) AS lo FROM w GROUP BY win),
h AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM w JOIN f USING (win) WHERE lo < doc_id),
g AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN h USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Records of all pages, read back from their archives; null html is an empty payload, repeated rows are written each."""
    return warc.digest(table(spark, sf, "pages"))


SQL["op1_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND top > page_id THEN top END AS refers_to FROM q
"""


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of whole texts; empty and null texts are scored too, documents without a label are not learnt."""
    return toxicity.digest(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op4_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with the lists that held their host when they were fetched; null URLs and those without a host are not blocked."""
    return urlfilter.digest(table(spark, sf, "pages"))


SQL["op4_url_filters"] = urlfilter.SQL


def op9_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Licenses in whole texts; empty and null texts hold none, documents of one id count as one."""
    return licenses.digest(table(spark, sf, "documents"), licenses.templates(spark))


SQL["op9_licenses"] = licenses.sql()


def op11_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' places, tokens and checksums, read back from token files; an empty or null text has the end id alone."""
    return tokenfiles.digest(table(spark, sf, "documents"))


def _crc_steps() -> str:
    """The CRC-32 remainders of the sixteen half-bytes, as an SQL list."""
    out = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return str(out)


def _crc32(x: str) -> str:
    """SQL for the CRC-32 of a string's UTF-8: half-bytes, the low one first."""
    halves = f"string_split(regexp_replace(hex(encode({x})), '(.)(.)', '\\2\\1', 'g'), '')"
    step = f"xor(c >> 4, ({_crc_steps()}::BIGINT[])[(xor(c, b) & 15) + 1])"
    return f"xor(list_reduce(list_transform({halves}, lambda h: ('0x' || h)::BIGINT), lambda c, b: {step}, 4294967295::BIGINT), 4294967295)::BIGINT"


def op12_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """Weights, scores and ranks of all documents; empty and null texts have no features and are not drawn."""
    return resample.digest(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


SQL["op12_resampling"] = f"""
WITH w AS (SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM (SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, item_id::BIGINT, text FROM benchmark)),
f AS (SELECT kind, doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda p: ws[p] || ' ' || ws[p + 1]))) AS f FROM w),
g AS (SELECT kind, f, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT f, {_crc32('f')} % 10000 AS b FROM (SELECT DISTINCT f FROM g)),
c AS (SELECT b, sum(CASE kind WHEN 0 THEN n ELSE 0 END)::BIGINT AS s, sum(CASE kind WHEN 1 THEN n ELSE 0 END)::BIGINT AS t FROM g JOIN b USING (f) GROUP BY b),
a AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM c),
gain AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM c, a),
d AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN b USING (f) JOIN gain USING (b) WHERE kind = 0 GROUP BY doc_id),
h AS (SELECT doc_id, len(ws) AS n_words, ('0x' || substr(sha256('7:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM w WHERE kind = 0),
s AS (SELECT doc_id, n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM s WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM s LEFT JOIN r USING (doc_id)
"""


def op13_spelling(spark: SparkSession, sf: str) -> DataFrame:
    """Words with their near words, forms and roots; null texts and tables without words give none."""
    return spelling.digest(table(spark, sf, "documents"))


SQL["op13_spelling"] = f"""
WITH RECURSIVE o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
k AS (SELECT w, {_crc32("doc_id::VARCHAR || ':' || w")} AS h, count(*) AS n FROM o WHERE length(w) >= 6 GROUP BY doc_id, w),
c AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n)::BIGINT AS n FROM k GROUP BY ALL),
v AS (SELECT word, n FROM c WHERE length(word) >= 6 AND n >= 5),
x AS (SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS p FROM v)),
e AS (SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
 UNION SELECT v.word, x.word, x.n FROM v JOIN x ON x.rest = v.word UNION SELECT x.word, v.word, v.n FROM v JOIN x ON x.rest = v.word),
m AS (SELECT word, near, n AS best_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, near) AS place FROM e),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 5 * v.n THEN near END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN m ON m.word = v.word AND place = 1),
r AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.up)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word WHERE r.up IS NULL
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc, op2_bpe, op3_toxicity, op4_url_filters, op5_quality, op6_token_counts, op7_substring_dedup, op8_decontaminate, op9_licenses, op10_near_duplicates, op11_token_files, op12_resampling, op13_spelling)
}
