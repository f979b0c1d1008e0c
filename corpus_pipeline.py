"""A training-data pipeline over ``documents``: five stages, each a table.

quality classifier, near-duplicate removal, redaction of personal data,
mixing of sources to target weights, packing.  Each stage gets what the one
before it kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrutix.llm import cnn, mixing, packing, pii, setsketch
from scrutix.llm.common import materialize, table

#: Five words and 80 percent, as for every near-duplicate stage.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    net = cnn.fit(docs, table(spark, sf_dir, "labels"))
    name = "_quality"
    while name in docs.columns:
        name += "_"
    return cnn.classify(docs, net, name=name).filter(F.col(name) >= cnn.THRESHOLD).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.

    Rows are documents, whatever their ids: different texts that share an id
    both stay, and rows without an id take part and are kept last.
    """
    # written once, so a row's number is the same wherever it is read
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("n"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), "numbered")
    found = setsketch.near_duplicates(rows.select(F.col("n").alias("doc_id"), F.col("row.text").alias("text")), SHINGLE, PERCENT)
    ids = rows.select("n", F.col("row.doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "n")).alias("first")
    kept = found.select(F.col("doc_id").alias("n"), "component_id").join(ids, "n").groupBy("component_id").agg(first).select(F.col("first.n").alias("n"))
    return rows.join(kept, "n", "left_semi").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by tags; ``n_chars`` follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered weights: none read less than once or more than twice."""
    return mixing.mix(docs, max_repeats=mixing.MAX_REPEATS, details=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their token ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing to target weights", target_weights),
    ("packing", pack),
]

#: A network, sketches, boosted trees and a tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's result is a written table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
