"""The corpus pipeline: filter, deduplicate, mix and pack ``documents``.

Every stage takes what the one before it kept, as written to Parquet and read
again, and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirecube.llm import language_id, mixing, near_dups, packing, toxicity
from hirecube.session import checkpoint, scratch_path

MIN_LANGUAGE_SCORE = 0.25  # a certain text of four languages scores near 1, one that says nothing 0.25
#: One stage trains on samples and another hashes in numpy: no SQL for the rows. Tests compare the stages with plain versions.
ORACLE_SQL = None


def _learned(docs: DataFrame, n: int, out: int) -> DataFrame:
    return docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % n != out, F.lit(True)))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, taught by ``labels``, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs.select("doc_id", "text", "lang"), _learned(labels, 5, 0).select("doc_id", "toxic"))
    scored = toxicity.score(docs, model, docs.columns)
    return scored.where("predicted = 0").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier, taught by ``lang``, can tell."""
    model = language_id.fit(_learned(docs, 4, 2).select("doc_id", "text", "lang"), F.xxhash64(F.lit(4), "doc_id", "text"))
    scored = language_id.predict(docs, model, docs.columns)
    return scored.where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") > MIN_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    found = checkpoint(near_dups.near_duplicates(docs).where("stays").groupBy("doc_id", "text_hash").count())
    marked = docs.withColumn("_h", F.xxhash64("text"))
    match = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("_h") == F.col("f.text_hash"))

    def among(rows: DataFrame) -> DataFrame:
        return marked.alias("d").join(rows.alias("f"), match, "left_semi")

    # the same id and text may stand in several rows; such rows alone are merged
    once, repeated = among(found.where("count = 1")), found.where("count > 1")
    if repeated.isEmpty():
        return once.select(*docs.columns)
    merged = among(repeated).dropDuplicates(["doc_id", "_h"])
    return once.unionByName(merged).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to the nearest whole number: none to three times."""
    marked = docs.withColumn("_key", F.xxhash64("doc_id", "text", "source"))
    taken = mixing.mix(marked, doc_id="_key")
    # equal rows share a key; each takes the mean of what they got
    times = taken.where("size > 0").groupBy("doc_id").agg(
        F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias("_times")).where("_times > 0")
    return (
        marked.join(times.withColumnRenamed("doc_id", "_key"), "_key")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
    )


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in windows of the mixture's proportions."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        place = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
