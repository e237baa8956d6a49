"""The corpus pipeline: stages over whole documents, each written as Parquet and read again for the next.

Each stage is (spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents. Nothing here depends
on a sample of the documents but the fit of the toxicity network and the ordinary words of the secret scan, whose bounds are
documented there.

In every stage a null text counts as an empty one, further columns of documents go along unread, and an empty table gives an
empty one. Rows may share an id, or be repeated; what that means is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm import exact, jaccard, packing, pieces, secret_scan, toxicity
from curatrix.llm.common import crc_mod, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network takes for toxic go. It learns from the labels of four fifths of the documents.

    Rows are judged by their text alone, so repeated rows stay or go together; of several labels of one id the highest counts.
    Without labels, or with labels of one kind only, the network keeps what its share of toxic labels says: nothing goes
    unless all labels are toxic. Null ids have no label.
    """
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    return toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text the smallest id stays.

    Of rows that share that id and text one stays. Texts that are empty, null or white space alone are compared like others. A null id
    is above all others, so it stays only if no row with an id has its text.
    """
    return exact.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word n-grams at a similarity of 0.8 the smallest id of a group stays.

    Texts without words all stay, and so do rows with a null id, which link with nothing. Rows that share an id stay or go
    together.
    """
    return jaccard.one_of_each(docs, 5, 80, 100)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced, and n_chars follows the text. A null text stays null."""
    ratios = secret_scan.train(secret_scan.labelled_samples(spark, docs))
    found = secret_scan.scan(docs, ratios, to="_spans")
    text = secret_scan.redacted(F.col("text"), F.col("_spans"))
    changed = found.withColumn("_text", text)
    size = F.when(F.size("_spans") > 0, F.length("_text").cast("long")).otherwise(F.col("n_chars"))
    return changed.withColumn("n_chars", size).withColumn("text", F.col("_text")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the permitted lengths: the token ids of all documents, and whose they are. A document without tokens
    has a row of its own, in no bin; null ids and repeated rows are packed like others."""
    return packing.sequences(pieces.encode(docs.select("doc_id", "text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The first stage is a trained network, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
