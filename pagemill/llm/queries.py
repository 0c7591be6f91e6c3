"""The registered queries of the training-data operators: each applies its operator to the whole
table with production parameters and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import conversations, ctw, html_text, language_id, license_scan, mixing, mtree, near_vectors, packing, simhash, spelling, suffix_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), vocabulary()))


@query
def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    s = toxicity.score(docs, model)
    return s.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def quality_weight(labels: DataFrame) -> DataFrame:
    """(_id, _weight): labelled good documents draw with weight 2, bad ones with 0.5; others have 1."""
    q = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"))
    return q.select("_id", F.when(F.col("_q") == 1, 2.0).when(F.col("_q") == 0, 0.5).otherwise(1.0).alias("_weight"))


def weighted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    q = quality_weight(labels)
    return docs.join(q, docs["doc_id"] == q["_id"], "left").drop("_id")


@query
def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    m = mixing.mix(weighted(docs, table(spark, sf_dir, "labels")), weight="_weight")
    return m.select("doc_id", "source", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.col("_copies")).alias("taken"))


@query
def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


@query
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = mtree.quantized(table(spark, sf_dir, "embeddings"))
    return mtree.top_k(v, v.where(F.col("vec_id") % 20 == 0))


@query
def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(table(spark, sf_dir, "conversations"))


@query
def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.select("doc_id", "text", "lang"))
    p = language_id.predict(docs.select("doc_id", "text"), model)
    return p.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return v.select(F.col("w").alias("word"), "form", "root", "n", "n_near", "form_n")


GOOD = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"

ORACLES["op9_topk"] = f"""
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS q FROM embeddings WHERE vec_id IS NOT NULL AND {GOOD}),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

# Every row is a vector of its own, also where a vec_id repeats; rows are numbered for that.
ORACLES["op10_near_vectors"] = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding, label FROM embeddings),
v AS (SELECT rid, label, list_transform(embedding, lambda c: c::DOUBLE) AS x FROM e
      WHERE label IS NOT NULL AND {GOOD} AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
n AS (SELECT *, sqrt(list_dot_product(x, x)) AS norm FROM v),
l AS (SELECT a.rid AS a, b.rid AS b FROM n a JOIN n b ON a.label = b.label AND a.rid <> b.rid AND len(a.x) = len(b.x)
      WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a, min(e.vec_id) AS least FROM r JOIN e ON e.rid = r.b GROUP BY r.a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(k.n_links, 0)::BIGINT AS n_links, least(e.vec_id, c.least) AS component_id,
       least(e.vec_id, c.least) = e.vec_id AS kept
FROM e LEFT JOIN k ON k.a = e.rid LEFT JOIN c ON c.a = e.rid"""
