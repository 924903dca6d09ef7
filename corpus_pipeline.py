"""A corpus, cleaned: toxicity, line dedup, near-dedup, decontamination, source mixing.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame; what it gives is written as Parquet and
read back as the next stage's ``docs``.  All stages but the last keep the columns of ``documents``, whatever further ones
there are; names that stages add for themselves begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnflow.llm import decontaminate, line_dedup, mixing, superminhash, toxicity
from tarnflow.llm._store import materialize
from tarnflow.session import ship_package

#: Jaccard similarity, in per cent, from which documents are near duplicates.
NEAR = 80
#: Ids up to which they are sent to every executor.
MAX_LOCAL = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more go; the machine learns from ``labels`` and these documents.  Null texts have the score of empty ones; null doc_ids are scored too."""
    ship_package(spark)
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, machine, "__toxicity").filter(F.col("__toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites stay in one document; a document that loses its whole text goes.  Null texts stay null; a null doc_id is the smallest."""
    ship_package(spark)
    out = line_dedup.drop_boilerplate(docs)
    changed = F.col("ld_removed") > 0
    out = out.filter(~(changed & (F.btrim("text", F.lit(line_dedup.BLANKS + "\n")) == "")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays.

    Where doc_ids are null or repeated, rows are told apart by doc_id and text: those that are no copies all stay, and of a group the one with the smallest (doc_id, text), one with a doc_id ahead of one without.
    """
    ship_package(spark)
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("__rows")).filter("__rows > 1 or doc_id is null")
    if odd.isEmpty():
        found = superminhash.near_dedup(docs.select("doc_id", "text"), NEAR)
        # those that go are few next to those that stay; texts are met where they are while their ids are
        gone = materialize(found.filter("not kept").select(F.col("doc_id").alias("__id")), "near-gone")
        gone = F.broadcast(gone) if gone.count() <= MAX_LOCAL else gone
        return docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti").select(*docs.columns)
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))
    found = superminhash.near_dedup(keyed.select(F.col("__key").alias("doc_id"), "text"), NEAR)
    groups = materialize(found.select(F.col("doc_id").alias("__key"), F.col("component_id").alias("__group")).distinct(), "near-groups")
    named = keyed.select("__key", "doc_id", "text").join(groups, "__key")
    stays = named.groupBy("__group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text", "__key")).alias("s")).select("s.__key")
    one = keyed.join(materialize(stays, "near-kept"), "__key").withColumn("__n", F.row_number().over(Window.partitionBy("__key").orderBy("doc_id"))).filter("__n = 1")
    return one.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; with a null or repeated doc_id, all rows of that id."""
    ship_package(spark)
    pairs = decontaminate.contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = materialize(pairs.select(F.col("doc_id").alias("__id")).distinct(), "contaminated")
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources up to twice; in order of (mix_epoch, mix_place).  A null source is one of its own."""
    ship_package(spark)
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: Training the factorization machine has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
