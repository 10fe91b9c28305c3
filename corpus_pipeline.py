"""The corpus pipeline: quality, line dedup, near duplicates, mixing and packing of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenespark.llm import cotrain, lines, mixing, packing, partenum
from scenespark.llm._shared import materialize, unused
from scenespark.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs as a written table with a number for each row: ids may repeat or be null."""
    row = unused(docs, "row")
    return materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias(row)), "rows"), row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: every row of a rejected id (of an id that has both
    rejected and other rows, all rows). Rows with a null id stay. An empty table stays empty, and
    without labels of both kinds every row stays."""
    scores = materialize(cotrain.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "scores")
    bad = scores.where("not keep").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text. Null texts become empty; rows with a null id keep
    all lines, and rows that repeat an id count as one document."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar rows the one with the smallest id stays, null ids last; of several
    with that id the first. Rows are told apart by number, so rows that repeat an id, or have none,
    count each for itself. Rows without words are like nothing and stay."""
    rows, row = _rows(docs)
    comps = partenum.jaccard_components(rows, id_col=row).select(row, "component_id")
    named = rows.select(row, "doc_id").join(comps, row)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row))[row]
    kept = materialize(named.groupBy("component_id").agg(best.alias(row)).select(row), "kept")
    return rows.join(kept, row, "left_semi").select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice; rows that repeat an id each
    for itself. Rows without words are never taken."""
    rows, row = _rows(docs)
    taken = mixing.mix(rows, id_col=row).where("taken > 0").select(F.col(row), (F.col("taken") / F.col("size")).cast("int").alias("times"))
    return rows.join(taken, row).withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences of at most 4096 tokens; every row counts, repeated or not, and
    a null text is the end token alone."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixed), ("packing", packed)]

#: SQL expresses neither the classifier nor packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
