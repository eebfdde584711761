"""Cleaning of a training corpus: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written and read
again as the next stage's documents.  All but the last keep the columns of documents.

1. language: documents without a determinable language go (no text, or no letter in it);
2. lines: lines that many documents share stay in one of them only;
3. near_duplicates: one document of each group of near copies stays;
4. contamination: documents that hold a benchmark item go;
5. packing: the remaining ones form batches in length buckets.

Null texts go with the first stage.  Rows without an id pass stages 2 to 4.  Rows that repeat
an id are one document with several texts: they go or stay together in stages 3 and 4.  An
empty table gives an empty result, and columns beyond those of documents are kept, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civilspark.llm import buckets, contamination, jaccard, language, lines
from civilspark.llm.common import plain_names
from civilspark.session import materialise, read_table


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without a labelled text to learn from, documents with a letter stay."""
    plain, name = plain_names(docs)
    own = plain.where(~language.held_out(name["doc_id"]))
    net = language.fit(own, name["text"], name["lang"])
    if not net.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    labelled = language.identify(plain, net, name["text"])
    kept = labelled.where(F.col("lang_pred") != language.UNDETERMINED)
    return kept.select(*plain.columns).toDF(*docs.columns)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, name = plain_names(docs)
    index = lines.build(spark, plain, name["doc_id"], name["text"])
    kept = lines.deduplicated(index, plain, name["doc_id"], name["text"])
    kept = kept.select(*plain.columns).toDF(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each component; rows without an id stay."""
    found = jaccard.near_components(spark, docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_id"))
    gone = gone.distinct().hint("shuffle_hash")
    plain, name = plain_names(docs)
    kept = plain.join(gone, F.col(name["doc_id"]) == F.col("_id"), "left_anti")
    return kept.toDF(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return contamination.clean(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return buckets.pack(spark, docs)


STAGES = [
    ("language", languages),
    ("lines", shared_lines),
    ("near_duplicates", near_duplicates),
    ("contamination", decontaminated),
    ("packing", packed),
]
# A trained network and a dynamic programme decide here, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
