"""Curation of a document corpus in five stages, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return the columns of docs, whatever else they
hold.  Rows without doc_id stay unless toxic; null and empty texts stay, as they are neither toxic, copies, repeats nor contaminated.  Rows that share
a doc_id but not their text are judged each by its own text; of rows that repeat both, the second stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm import decontaminate as benchmark
from tabforge.llm import jaccard, packing, substring, toxicity
from tabforge.llm.common import ID, few, identified, table, text_digest, without, written

COPY = "__tabforge_copy"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(few(docs, docs.count()), model, "__tabforge_score")
    return scored.where(F.col("__tabforge_score") < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the smallest doc_id stays."""
    joined = jaccard.jaccard_join(docs).where("doc_id is not null and n_grams > 0").groupBy("doc_id", F.col("copy").alias(COPY)).agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marked = written(joined.where("not kept or n > 1"), "repeats")
    left = without(docs.withColumn(COPY, text_digest("text")), marked.where("not kept"), ["doc_id", COPY], once=marked.where("kept"))
    return left.select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller doc_id has too are cut out; documents of which nothing is left go."""
    return substring.cut(docs, substring.passages(docs))


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with too much of the benchmark go."""
    own = identified(docs)
    found = benchmark.decontaminate(own, table(spark, sf_dir, "benchmark"), also=[ID]).where("contaminated").select(ID)
    return without(own, written(found, "contaminated"), [ID]).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(packing.pieces(docs))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("contamination", contaminated), ("packing", packed)]
#: No SQL: the stages train, chain and pack; the tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
