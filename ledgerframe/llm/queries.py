"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html, langid, licenses, minhash, mix, substring_dedup, topk, toxicity
from .common import LARGEST, text_or_empty

WORDS_SQL = r"'[^\x20\x09-\x0D]+'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix.plan_mix(table(spark, sf_dir, "documents"))
    names = ["position", *(f"position_{k}" for k in range(2, mix.CAP + 1))]  # of the first copy, the second, ...
    out = plan.withColumns({name: F.get("copies", F.lit(k))["position"] for k, name in enumerate(names)}).drop("copies")
    return mix.range_sorted(out).select("doc_id", "size", "source_size", "target", "taken", *names)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    return langid.predict(docs, model).withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    known = lambda c: F.when(F.col(c) < LARGEST, F.col(c))
    return found.select(known("id").alias("doc_id"), known("cluster_id").alias("cluster_id"), "cluster_size", "kept")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.removals(table(spark, sf_dir, "documents"))
    doc_id = F.when(F.col("id") < LARGEST, F.col("id")).alias("doc_id")
    return found.select(doc_id, "n_words", "n_removed", F.lower(F.hex("kept_sha")).alias("kept_sha256"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # A document lies in the folder that its source names, which "/" may nest. Without a source its place is unknown: it
    # gets a folder of its own that begins with "/", as no source's does; in the root it would speak for all.
    source = F.regexp_replace(F.regexp_replace("source", "/+", "/"), "^/|/$", "")
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(text_or_empty()))
    path = F.when(source != "", F.concat_ws("/", source, name)).otherwise(F.concat(F.lit("/"), name, F.lit("/text")))
    found = licenses.scanned(docs.select(F.col("doc_id").alias("key"), path.alias("path"), "text"), statements=False)
    return found.select(F.col("key").alias("doc_id"), "path", "license", "score", "how", "from_dir")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"), {"low_quality": "quality = 0", "toxic": "toxic = 1"})
    return toxicity.predict(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"))
    found = topk.top_k(vectors, F.col("id") % 100 == 0, 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


QUERIES = {
    "op1_mix": op1_mix,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_bpe": op3_bpe,
    "op4_langid": op4_langid,
    "op5_near_dedup": op5_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_licenses": op7_licenses,
    "op8_html": op8_html,
    "op9_toxicity": op9_toxicity,
    "op10_topk": op10_topk,
}

def _position_sql(share: str) -> str:
    """The inverted schedules of the three kinds of sources at a share of the target."""
    one, later = "1.0::DOUBLE", f"({share} * 3.0::DOUBLE - 1.75::DOUBLE)"
    return f"""CASE WHEN {share} IS NULL THEN NULL
            WHEN kind = 0 THEN least({one}, {share})
            WHEN kind = 1 THEN least({one}, 2.0::DOUBLE * ({share} * 2.0::DOUBLE) / ({one} + sqrt(greatest(0.0::DOUBLE, {one} + 4.0::DOUBLE * ({share} * 2.0::DOUBLE)))))
            WHEN {share} * 3.0::DOUBLE <= 1.75::DOUBLE
              THEN least({one}, 2.0::DOUBLE * ({share} * 3.0::DOUBLE) / (4.0::DOUBLE + sqrt(greatest(0.0::DOUBLE, 16.0::DOUBLE + -4.0::DOUBLE * ({share} * 3.0::DOUBLE)))))
            ELSE least({one}, 0.5::DOUBLE + 2.0::DOUBLE * {later} / (3.0::DOUBLE + sqrt(greatest(0.0::DOUBLE, 9.0::DOUBLE + -4.0::DOUBLE * {later}))))
       END"""


ORACLE = {
    "op1_mix": rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {WORDS_SQL})) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS ord
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind
  FROM d GROUP BY source
), w AS (SELECT *, CAST(kind + 1 AS DOUBLE) AS weight FROM s),
r AS (
  SELECT *, row_number() OVER o AS place,
         CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_weight
  FROM w WINDOW o AS (ORDER BY source_size / weight, kind, source NULLS LAST)
), f AS (SELECT min(place) AS first FROM r WHERE weight * left_words <= 3 * source_size * left_weight),
t AS (
  SELECT r.source, r.source_size, r.kind,
         CASE WHEN r.source_size = 0 THEN 0.0
              WHEN r.place >= f.first THEN r.weight * x.left_words / x.left_weight
              ELSE 3.0 * r.source_size END AS target
  FROM r CROSS JOIN f JOIN r x ON x.place = f.first
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.kind, CAST(t.target AS DOUBLE) AS target,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS goal FROM p
), c AS (
  SELECT *, least(size, greatest(0, goal - start)) AS c0, least(size, greatest(0, goal - source_size - start)) AS c1,
         least(size, greatest(0, goal - 2 * source_size - start)) AS c2
  FROM q
), v AS (SELECT *, {", ".join(f"CASE WHEN c{k} > 0 THEN (start + {k} * source_size + c{k} / 2.0::DOUBLE) / target END AS share{k}" for k in range(3))} FROM c)
SELECT doc_id, size, source_size, target, CAST(c0 + c1 + c2 AS BIGINT) AS taken,
       {", ".join(f"{_position_sql(f'share{k}')} AS {name}" for k, name in enumerate(("position", "position_2", "position_3")))}
FROM v
""",
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST)
""",
    "op6_substring_dedup": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS_SQL}) AS w FROM documents
), s AS (
  SELECT doc_id, generate_subscripts(w, 1) AS p, w, len(w) AS n FROM d
), v AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM s WHERE p + 49 <= n
), f AS (SELECT h, min(doc_id) AS first FROM v GROUP BY h),
x AS (SELECT v.doc_id, v.p FROM v JOIN f USING (h) WHERE v.doc_id > f.first),
c AS (
  SELECT s.doc_id, s.p, s.w[s.p] AS word,
         coalesce(max(x.p) OVER (PARTITION BY s.doc_id ORDER BY s.p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM s LEFT JOIN x ON x.doc_id = s.doc_id AND x.p = s.p
), g AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept
  FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
""",
    "op10_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM p
)
SELECT * FROM r WHERE rank <= 10
""",
}
