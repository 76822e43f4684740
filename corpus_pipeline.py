"""A training corpus from the documents, in five stages.

Each stage works on everything its predecessor kept; its result is written as
Parquet and read again as the next one's documents.  All stages but the last
return the columns of documents.  Part of the subpackage llm.

toxicity         documents with a toxicity score of 0.5 or more go; the
                 classifier learns from the labelled rows of ``labels``
near_duplicates  of each group of similar texts one row stays: one with the
                 smallest doc_id (rows without any come last); texts without
                 words are in no group and all stay
decontamination  documents with a passage of ``benchmark`` go
source_mix       the words that the mix takes: a row for each pass over a
                 source and text, so a doc_id comes twice at most
token_records    token ids written as binary records and read back
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thaiseg.llm import decontaminate, ngram_join, source_mix, storage, token_records, toxicity
from thaiseg.llm.catalog import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = storage.only(docs, *COLUMNS)
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxicity_scores(spark, docs, model).where("toxicity_score < 0.5").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = storage.only(docs, *COLUMNS)
    # texts are grouped under their hashes, so ids may repeat, clash or be missing
    groups = ngram_join.similar_documents(spark, docs.select(F.xxhash64("text").alias("doc_id"), "text"))
    groups = groups.where("n_shingles > 0").select(F.col("doc_id").alias("th"), "component_id").distinct()
    key = F.xxhash64(*[x for c in COLUMNS for x in (F.col(c), F.col(c).isNull())])
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), key.alias("key")).groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("th").alias("th"), F.count("*").alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "n")
    rows = rows.join(groups, "th")
    stays = rows.groupBy("component_id").agg(F.min(place).alias("x")).select("x.key", "x.n")
    tables = storage.Tables(spark, "near-duplicates")
    # keys that go, and those of which one of several equal rows stays
    fate = tables.write(rows.select("key").join(stays, "key", "left").where("n is null or n > 1").select("key", F.col("n").isNotNull().alias("one")), "fate")
    keyed = docs.withColumn("key", key)
    kept = keyed.join(fate, "key", "left_anti")
    once = keyed.join(fate.where("one"), "key", "left_semi").dropDuplicates(["key"])
    return kept.union(once).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(spark, storage.only(docs, *COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(spark, docs).select(*COLUMNS)


def token_record_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_records.tokenized(spark, docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("source_mix", source_mix_stage),
    ("token_records", token_record_stage),
]

#: The first stage scores with a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = storage.Tables(spark, "pipeline")
    docs = storage.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
