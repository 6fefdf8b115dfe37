"""From raw documents to packed training sequences: five stages, each one operator of ``gridshift.llm``.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes
each one's result as Parquet and reads it back as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridshift.llm import common, langid, mixing, nearcopies, packing, quality


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; it learns from the labels of documents that are here.

    A null or empty text is scored as an empty one, a very long one whole; null lang, source and n_chars are values of their
    own. Without labels, or with good ones only, all stay. Equal rows have equal scores: all stay or all go. A score of
    exactly one half stays. An empty table stays empty.
    """
    renamed, back = common.aside(docs, quality.NEW)
    return back(quality.score(renamed, common.documents(spark, sf_dir, "labels")).where("keep"))


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: with a letter, and with one language ahead. Without any labelled document all stay.

    Null, empty and letterless texts go; very long ones are parsed whole; a tie of all languages is none ahead. Equal rows
    all stay or all go. Null doc_id, source or n_chars make no difference; rows without lang teach nothing.
    """
    return langid.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near copies: five-word shingles, similarity 0.8 or more.

    Null, empty and wordless texts are one class, very long ones count whole. Of equal rows one stays; rows that share
    a doc_id but not the text are judged each by its own text. Rows without doc_id have no class and stay.
    """
    return nearcopies.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in files and rows ordered by their position in the mix.

    A null source is the empty one. Texts are not looked at, so null, empty and very long ones are rows like others. Equal rows
    have places of their own; ties of the hash that orders a source go by doc_id. An empty table stays empty.
    """
    n, parts = docs.count(), common.partitions(spark)
    renamed, back = common.aside(docs, mixing.NEW)
    part = (F.col("mix_position") * parts / max(1, n)).cast("int")
    return back(mixing.mix(renamed).repartitionById(parts, part).sortWithinPartitions("mix_position"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences, which follow the order of ``docs`` in its files: the mix.

    Null and empty texts are one end id; very long ones are cut into full windows and a rest. Equal rows are packed as often as
    they occur, each at its own place; a null doc_id stays null. An empty table gives no rows.
    """
    return packing.pack(common.in_file_order(docs, ["doc_id", "text"], "__place"), order="__place")


STAGES = [
    ("quality classifier", quality_filter),
    ("language ID", language_filter),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the trained stages nor XXH64 fingerprints nor token ids; tests/llm holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.staged(docs)
    return docs
