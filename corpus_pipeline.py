"""Documents to a training mix, in five stages. Each takes (spark, docs, sf_dir) and returns a DataFrame. Other columns of
the input may have any name and stay; an empty table gives an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, mixture, templates, toxicity
from tessera.llm.common import materialise, spread, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is predicted toxic go; all columns stay. Null texts and texts without words stay, as does every row
    where labels of both classes are missing. Repeated rows fare alike; ids may be null or repeat; texts may be of any
    length."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and rows of which nothing is left; n_chars follows the text. Null texts, texts
    without words and all other columns stay as they are; repeated rows fare alike and count as one document, as near
    copies do; lines may be of any length."""
    return templates.without_recurring_lines(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("bigint")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (80 % of their five-word shingles) stays: that of the least doc_id. Rows
    that repeat doc_id and text become one; rows with a null id stay, as do null texts and texts without words, which are
    like no other; all columns stay."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark passage, at least 80 % of its words in place, go; all columns stay. Null and empty
    texts stay, null and empty items find nothing, repeated rows fare alike, an empty benchmark leaves every row."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns, with what the mix takes of each and its places in training, sorted by the first of them; what
    it leaves out is last. Made columns whose names the input has already are called mix_ and the name. Null and empty
    texts are not taken; the null source is a source; repeated rows have places of their own."""
    return mixture.mix(docs, keep=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_recurring_lines), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_leaks), ("mixing sources to target weights", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
