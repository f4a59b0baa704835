"""A corpus pipeline: quality, exact and near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``.  Stages are joined by Parquet tables.  No stage but the exact dedup is something
that SQL can express (a fitted model, linked shingle sets, transducers, tokens), so ``ORACLE_SQL``
is None and tests compare ``run`` with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import exact_dedup, ngram_join, packing, pii, quality
from docloom.llm.common import materialise
from docloom.llm.registry import table, vocabulary

#: Near duplicates: five-word shingles, a similarity of 0.8 or more.
NEAR_WORDS, NEAR_FROM = 5, (80, 100)

ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on rated documents among ``docs``, keeps.

    Null text is scored as empty, and so may go; null flags of a rating count as 0, rows of ``labels``
    without doc_id or document as none.  Rows that repeat a document are kept or go alike.  Without
    ratings nothing tells grades apart.  An empty table stays empty; further columns come along.
    """
    model = quality.train(docs, quality.ratings_of(table(spark, sf_dir, "labels")))
    return quality.kept_rows(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts.

    Texts are equal without blanks; the longest original, then the smallest doc_id stays, and a null
    doc_id loses to any other.  Null text counts as empty.  Of rows that repeat doc_id and text one
    stays.  An empty table stays empty; further columns come along.
    """
    return exact_dedup.kept_rows(docs, exact_dedup.exact_duplicates(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of linked texts.

    Texts without words link with none and stay, as do rows without doc_id.  An empty table stays
    empty; further columns come along.
    """
    return ngram_join.one_of_each(docs, ngram_join.jaccard_components(docs, NEAR_WORDS, NEAR_FROM))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind.

    Every row stays; null text stays null; ``n_chars`` is counted anew.  Further columns come along.
    """
    return pii.mask_personal_data(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their places in training sequences.

    Null text is packed as empty: the end id alone.  Rows that repeat a document are packed each, a
    null doc_id is kept, long texts are several pieces.  No rows give no rows.
    """
    return packing.packed_documents(docs, *vocabulary())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
