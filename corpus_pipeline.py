"""A corpus pipeline of five text operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a frame that ``run`` writes as Parquet to the
shared folder and reads again for the next one. All but the last return the columns of documents,
of which all but the text travel in one struct, so that their names cannot clash and no text is
moved twice; ``n_chars`` follows the text. A null text is an empty one; rows with a null id are
judged and packed but not compared with others; rows of one id go together as near copies.
ORACLE_SQL is None: SQL cannot express the line model, sketching and packing, so tests compare the
stages with brute force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm import line_labels, near_copies, packing, secrets, substring_words
from gridwright.llm.common import ship_code, stored

#: Near-duplicate stage: words of a shingle and least similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one struct, with a mark of null texts."""
    others = [
        F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"),
        F.struct(text.isNull().alias("no_text"), *others).alias("_row"))


def _unpacked(docs: DataFrame, found: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of ``docs`` again, with another text if one is given."""
    new = {"text": F.when(~F.col("_row.no_text"), F.col("text"))}
    if text is not None:
        new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return found.select(*[
        new.get(c, F.col(f"_row.c{i}")).alias(c) for i, c in enumerate(docs.columns)])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are mostly boilerplate lines go."""
    ship_code(spark)
    rows = _packed(docs)
    field = line_labels.trained(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(docs, line_labels.judged(rows, field).where("kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    ship_code(spark)
    rows = _packed(docs)
    found = near_copies.linked(rows.select("doc_id", "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    gone = found.where("not kept").select("doc_id").distinct()
    return _unpacked(docs, rows.join(gone, "doc_id", "left_anti"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document holds are cut out; what is left of
    such a document is joined by spaces, all others stay as they are."""
    ship_code(spark)
    out = substring_words.remove_repeats(_packed(docs))
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("text"))
    return _unpacked(docs, out, text)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced by a mark."""
    ship_code(spark)
    return _unpacked(docs, secrets.scanned(_packed(docs)), F.col("masked"))


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of what is left."""
    ship_code(spark)
    return packing.packed(_packed(docs).select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("secret scan", masked_secrets),
    ("packing", packed_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
