"""The queries opN_<name> of this subpackage: thin uses of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import digest, language, lines, mixing, pieces, simhash, suffixes, tokenfile, toxicity, vectors
from lineweave.llm.common import documents, tune

#: Files of public tokenizers; queries take them from the installed package by name.
WORD_BPE, PIECE_BPE, END_ID = "word_bpe_49k.json", "piece_bpe_32k.model", 1


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(documents(spark, sf_dir), within=False)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return tokenfile.read(spark, *tokenfile.write(docs, tokenizer_path(WORD_BPE), END_ID))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(documents(spark, sf_dir), tokenizer_path(PIECE_BPE))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(documents(spark, sf_dir))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edited_likeness(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_simhash, op4_token_files, op5_sentencepiece, op6_language, op7_mixing, op8_embeddings, op9_line_dedup, op10_fingerprints)}


#: Same rows by a sort of each source's documents, where the operator narrows histograms.
_OP7 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS weight FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
r AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS k FROM c),
l AS (SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
f AS (SELECT min(k) AS k FROM l WHERE cap > budget / rest * weight),
t AS (SELECT l.source, l.source_size,
             CASE WHEN f.k IS NULL OR l.k < f.k THEN l.cap ELSE (SELECT budget / rest FROM l AS m WHERE m.k = f.k) * l.weight END AS target
      FROM l, f),
n AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 2)::BIGINT END AS times FROM t),
g AS (SELECT source, h, sum(size) AS words FROM d GROUP BY source, h),
u AS (SELECT g.source, g.h, g.words, n.target - n.times * n.source_size AS need,
             sum(g.words) OVER (PARTITION BY g.source ORDER BY g.h) AS upto
      FROM g JOIN n ON g.source IS NOT DISTINCT FROM n.source WHERE g.words > 0),
e AS (SELECT source, min(CASE WHEN 2 * (need - upto + words) >= words THEN h + 1 ELSE h END) AS cut
      FROM u WHERE upto >= need AND upto - words < need GROUP BY source)
SELECT d.doc_id, d.size, n.source_size, n.target,
       ((n.times + CASE WHEN d.h < coalesce(e.cut, 0) AND n.target - n.times * n.source_size > 0 THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""


#: Every stretch of 50 words as one string, where the operator sorts suffixes at minimisers only.
_OP1 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS pos FROM w WHERE len(ws) >= 50),
s AS (SELECT doc_id, pos, array_to_string(ws[pos + 1:pos + 50], ' ') AS stretch FROM p),
r AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY stretch) AS least, max(doc_id) OVER (PARTITION BY stretch) AS most FROM s),
b AS (SELECT *, CASE WHEN pos > lag(pos) OVER d + 50 OR lag(pos) OVER d IS NULL THEN 1 ELSE 0 END AS fresh FROM r WHERE least < most WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM b)
SELECT doc_id, min(pos)::BIGINT AS start_word, (max(pos) + 50)::BIGINT AS end_word, (max(pos) + 50 - min(pos))::BIGINT AS n_words,
       CASE WHEN min(least) <> doc_id THEN min(least) ELSE max(most) END AS partner_id
FROM g GROUP BY doc_id, run
"""

#: All pairs of vectors, then as many rounds of smallest reachable ids as there are.
_OP8 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
f AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) = len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM f AS a JOIN f AS b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.95),
c AS (
  SELECT vec_id AS node, vec_id AS root FROM f
  UNION
  SELECT l.v, c.root FROM c JOIN l ON l.u = c.node WHERE c.root < l.v),
m AS (SELECT node, min(root) AS component_id FROM c GROUP BY node),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(m.component_id, v.vec_id) AS component_id, coalesce(m.component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN m ON m.node = v.vec_id LEFT JOIN n ON n.u = v.vec_id
"""


#: All pairs of lines of like length of which one has a third of the other, whose edit distance is then taken.
_OP9 = r"""
WITH RECURSIVE o AS (
  SELECT doc_id, i - 1 AS line, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS x
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL))),
p AS (SELECT * FROM o WHERE x <> ''),
d AS (SELECT x, row_number() OVER (ORDER BY x) AS id, length(x) AS n FROM (SELECT DISTINCT x FROM p)),
l AS (
  SELECT a.id AS u, b.id AS v FROM d AS a JOIN d AS b
    ON b.n BETWEEN a.n AND a.n + 2 AND (b.n > a.n OR b.id > a.id) AND a.n >= 20
   AND (contains(b.x, a.x[:a.n // 3]) OR contains(b.x, a.x[a.n // 3 + 1:2 * (a.n // 3)]) OR contains(b.x, a.x[2 * (a.n // 3) + 1:]))
  WHERE levenshtein(a.x, b.x) <= 2),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
c AS (SELECT id AS node, id AS root FROM d UNION SELECT e.v, c.root FROM c JOIN e ON e.u = c.node WHERE c.root < e.v),
m AS (SELECT node, min(root) AS class FROM c GROUP BY node),
k AS (SELECT u, count(*) AS n_links FROM e GROUP BY u),
q AS (SELECT p.doc_id, p.line, d.n, coalesce(k.n_links, 0) AS n_links, (p.doc_id, p.line) <> min((p.doc_id, p.line)) OVER (PARTITION BY m.class) AS again
      FROM p JOIN d USING (x) JOIN m ON m.node = d.id LEFT JOIN k ON k.u = d.id),
g AS (SELECT doc_id, count(*) AS n_lines, sum(n_links) AS n_links, count(*) FILTER (again) AS n_again, coalesce(sum(n) FILTER (NOT again), 0) AS kept_chars FROM q GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_again, 0)::BIGINT AS n_again, coalesce(kept_chars, 0)::BIGINT AS kept_chars
FROM documents AS t LEFT JOIN g USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": _OP1, "op7_mixing": _OP7, "op8_embeddings": _OP8, "op9_line_dedup": _OP9}
