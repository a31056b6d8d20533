"""One query for each operator of this subpackage, over its whole table, and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import audio_digests
from .bpe import bpe_round_trip
from .common import documents
from .jaccard import jaccard_components
from .lines import dedup_lines
from .mixing import mix
from .quality import judge
from .search import bm25_top_k
from .substring import dedup_substrings
from .token_counts import token_counts
from .warc import warc_derivatives


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "lang", F.exp("log_perplexity").alias("perplexity"), F.exp("threshold").alias("threshold"), "keep")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digests(documents(spark, sf_dir))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("long").alias("copies"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return bm25_top_k(docs, docs.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_quality, op2_token_counts, op3_bpe, op4_jaccard, op5_mixing, op6_lines, op7_audio, op8_search, op9_warc, op10_substrings)}
WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op4_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_distinct([array_to_string(ws[k + 1 : k + 4], ' ') FOR k IN range(0, len(ws) - 3)]) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS t FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * i.n >= 85 * (x.n + y.n - i.n)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = d.doc_id""",
    "op5_mixing": f"""
WITH s AS (SELECT doc_id, source, CAST(len({WORDS.format("text")}) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS code FROM documents),
r AS (SELECT *, CAST('0x' || substr(code, 1, 8) AS BIGINT) % 1024 AS block FROM s),
b AS (SELECT source, block, sum(size) AS words FROM r GROUP BY source, block),
z AS (SELECT source, sum(words) AS source_size FROM b GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM z),
q AS (SELECT *, 3 * source_size / weight AS ratio FROM w),
v AS (SELECT *, row_number() OVER o AS place, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER p, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS level FROM q WINDOW o AS (ORDER BY ratio, source NULLS LAST), p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CAST(CASE WHEN level > ratio THEN 3 * source_size ELSE (SELECT arg_min(level, place) FROM v WHERE level <= ratio) * weight END AS DOUBLE) AS target FROM v),
m AS (SELECT b.source, b.block, b.words, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN least(floor(t.target / t.source_size), 3) ELSE 0 END AS whole FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, target - whole * source_size - coalesce(sum(words) OVER (PARTITION BY source ORDER BY md5('mix:block:' || block), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM m),
c AS (SELECT r.*, o.source_size, o.target, o.whole, o.room, o.words, coalesce(sum(r.size) OVER (PARTITION BY r.source, r.block ORDER BY code, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + r.size / 2 AS middle FROM r JOIN o ON r.source IS NOT DISTINCT FROM o.source AND r.block = o.block),
k AS (SELECT *, CAST(whole + CASE WHEN whole < 3 AND room > 0 AND (room >= words OR middle <= room) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target, size * copies AS taken, copies FROM k""",
    "op6_lines": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents WHERE text IS NOT NULL),
one AS (SELECT line, min({'d': doc_id, 'k': k}) AS f FROM l GROUP BY line),
w AS (SELECT doc_id, k, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS b FROM l),
two AS (SELECT a, b, min({'d': doc_id, 'k': k}) AS f FROM w WHERE b IS NOT NULL AND length(trim(a, ' ')) + length(trim(b, ' ')) > 0 GROUP BY a, b),
gone AS (SELECT doc_id, k FROM l JOIN one USING (line) WHERE length(trim(line, ' ')) >= 24 AND f <> {'d': doc_id, 'k': k} UNION SELECT doc_id, k + i FROM (SELECT doc_id, k FROM w JOIN two USING (a, b) WHERE f <> {'d': doc_id, 'k': k}), range(2) r(i)),
x AS (SELECT l.doc_id, count(*) AS n, count(g.k) AS gone, string_agg(line, chr(10) ORDER BY l.k) FILTER (g.k IS NULL) AS kept FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(x.n, 0) AS n_lines, coalesce(x.gone, 0) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256 FROM documents d LEFT JOIN x USING (doc_id)""",
    "op8_search": f"""
WITH t AS (SELECT doc_id, unnest({WORDS.format(LOWER)}) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
l AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS n FROM documents d LEFT JOIN f USING (doc_id) GROUP BY 1),
a AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
i AS (SELECT term, ln(1 + (docs - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, a GROUP BY term, docs),
s AS (SELECT q.doc_id AS query, f.doc_id, sum(idf * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM f q JOIN f USING (term) JOIN i USING (term) JOIN l ON l.doc_id = f.doc_id, a WHERE q.doc_id % 20 = 0 GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query, rank, doc_id, round(score, 6) AS score FROM k WHERE rank <= 10""",
    "op10_substrings": f"""
WITH w AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS k FROM w WHERE len(ws) >= 50),
h AS (SELECT doc_id, k, md5(array_to_string(ws[k + 1 : k + 50], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS d FROM h GROUP BY h),
g AS (SELECT DISTINCT doc_id, k + i AS p FROM h JOIN f USING (h), range(50) r(i) WHERE d < doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS p FROM w),
x AS (SELECT p.doc_id, count(*) AS n, count(g.p) AS gone, string_agg(word, ' ' ORDER BY p.p) FILTER (g.p IS NULL) AS kept FROM p LEFT JOIN g ON g.doc_id = p.doc_id AND g.p = p.p GROUP BY p.doc_id)
SELECT d.doc_id, coalesce(x.n, 0) AS n_words, coalesce(x.gone, 0) AS n_removed, sha256(coalesce(x.kept, '')) AS kept_sha256 FROM documents d LEFT JOIN x USING (doc_id)""",
}
