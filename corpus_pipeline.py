"""A training corpus from `documents`: toxicity filter, SimHash near-dedup, suffix-array dedup,
mixing of sources, packing. Each stage's result is written as Parquet and read as the next one's
documents; every stage but the last returns the columns that it was given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import mixing, packing, simhash, suffix_dedup, toxicity
from pagemill.llm.common import guarded, shared_folder
from pagemill.llm.queries import table, vocabulary, weighted

KNOWN = ("doc_id", "text", "source")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5. The model learns from the labelled rows of `docs` that aren't held out."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return guarded(docs, KNOWN, lambda d: toxicity.score(d, model).where("_score < 0.5").drop("_score"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that a 100-byte string of an earlier document, or earlier in the same
    one, covers. A character that is cut in two goes whole; documents of which nothing is left go;
    n_chars, where there is one, is that of the new text."""

    def cut(d: DataFrame) -> DataFrame:
        out = suffix_dedup.dedup(d, as_text=True).where((F.col("n_removed") == 0) | (F.octet_length("kept") > 0)).withColumn("text", F.col("kept"))
        if "n_chars" in d.columns:
            out = out.withColumn("n_chars", F.length("text").cast(d.schema["n_chars"].dataType))
        return out.select(*d.columns)

    return guarded(docs, (*KNOWN, "n_chars"), cut)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (none to three times). The mix is decided on rows
    without their texts, identical rows together; the decisions are joined to the documents."""

    def mix(d: DataFrame) -> DataFrame:
        keyed = d.withColumn("_row", F.struct("doc_id", "source", F.xxhash64("text").alias("h")))
        light = keyed.groupBy("_row").agg(F.sum(mixing.word_count(F.col("text"))).alias("_size"))
        light = light.withColumns({"doc_id": F.col("_row.doc_id"), "source": F.col("_row.source")})
        taken = mixing.mix(weighted(light, table(spark, sf_dir, "labels")), size="_size", weight="_weight")
        taken = taken.where("_copies > 0").select("_row", "_copies")
        return keyed.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*d.columns)

    return guarded(docs, KNOWN, mix)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, vocabulary()))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("suffix_dedup", suffix_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the tokenizer or the trained model; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of `sf_dir`; stage results are written
    under the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
