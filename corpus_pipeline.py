"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and all rows its predecessor kept; all but the last return the columns of
documents; other columns, whatever their names, are left out.  Null texts and texts without a letter go in the first stage;
very long texts are worked through whole; rows that repeat an id and tie in similarity leave one row; rows whose id is null
pass the near-duplicate stage, which decides by id, and are judged by their text elsewhere.  Empty tables pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm import decontam, langid, linededup, mixing, ngramjoin
from strandline.llm.storage import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A prediction below this, or below twice a guess among the languages learned, is rejected.
LEAST_SCORE = 0.4


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among ids; only those that a filter of fixed size can't clear are shuffled."""
    touched = ngramjoin.id_filter(docs.sparkSession, ids)
    rest = ngramjoin.only_ids(docs, touched).join(ids, "doc_id", "left_anti")
    return ngramjoin.only_ids(docs, touched, inverse=True).union(rest)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those no language fits; the language found becomes lang.  Where no document has a
    known language nothing can be learned, and all stay as they are."""
    model = langid.fit_languages(docs)
    if not model["langs"]:
        return docs.select(COLUMNS)
    least = min(LEAST_SCORE, 2 / len(model["langs"]))
    found = langid.predict_languages(docs.select(COLUMNS), model).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return found.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later occurrences of repeated three-line windows."""
    cut = linededup.dedup_lines(docs.select(COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the similarity join stays, the one with the smallest id; of rows with one id, one."""
    docs = docs.select(COLUMNS)
    found = Workspace(spark, "near").keep(ngramjoin.jaccard_components(docs), "found")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    left = _without(docs, gone)
    touched = ngramjoin.id_filter(spark, again)
    first = Window.partitionBy("doc_id").orderBy("text", "source", "lang", "n_chars")
    once = ngramjoin.only_ids(left, touched).withColumn("r", F.row_number().over(first)).where("r = 1").select(COLUMNS)
    return ngramjoin.only_ids(left, touched, inverse=True).union(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items."""
    return decontam.flag_contamination(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select(COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mixing", source_mixing)]

#: Learned predictions and seeded draws are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return docs
