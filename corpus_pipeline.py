"""From raw documents to packed training sequences, in stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as
the next one's docs. All but the last return the columns of documents. SQL can't express the stages.

Edge cases: an empty table passes through all stages as an empty one, and columns beyond those used pass
unchanged up to packing. A null or empty text is not toxic, has no language (so the second stage drops it)
and links with nothing; packed alone it would be the end mark. Rows without an id are judged like others:
they teach, and in a group of near duplicates they come after rows with one. Repeated rows are judged alike
by the first two stages, and one of them stays in the third. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import common, jaccard, langid, packing, toxicity

#: The nearness to the nearest language that a text needs: far below that of any prose, above that of texts without words.
LEAST_SCORE = 0.2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold. Learns from labelled rows with crc32(doc_id) mod 4 other than 2; without any, all documents stay."""
    teaches = common.remainder("doc_id", 4) != 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(teaches)
    return toxicity.keep_clean(docs, toxicity.fit(docs.filter(teaches), labels))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: with letters, and near to some language's profile. Learns from rows with a language and crc32(doc_id) mod 4 other than 2; without any, no document has a language."""
    return langid.keep_languages(docs, langid.fit(docs.filter(common.remainder("doc_id", 4) != 2)), LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group that shares five-word shingles at a similarity of 0.8 or more."""
    return jaccard.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents left, packed into sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language", keep_languages), ("near_duplicates", drop_near_duplicates), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
