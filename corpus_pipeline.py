"""A corpus pipeline over `documents`: identify languages, drop boilerplate lines, drop near-duplicates, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's docs. All stages but the last return the columns of documents. Stages judge all the
documents that their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.llm import langid, lines, mixing, packing, similar
from timelode.llm.common import columns_of, fresh, quoted, save

#: Documents whose best language scores below this are rejected, as are those without a letter.
MIN_LANGUAGE_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; repeated rows are kept or rejected alike."""
    lang, score = fresh(docs, "_lang_pred", "_score")
    found = langid.identify(docs, langid.train(docs, F.lit(True)), lang_name=lang, score_name=score)
    return found.filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*columns_of(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are boilerplate of their source; n_chars follows the text. No document goes."""
    n_lines, n_dropped = fresh(docs, "_n_lines", "_n_dropped")
    found = lines.drop_boilerplate(docs, counts=(n_lines, n_dropped))
    n_chars = F.when(F.col(n_dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(*[n_chars if c == "n_chars" else quoted(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays.

    Rows that share a doc_id count as one document and stay or go together; rows with a null doc_id stay.
    """
    groups = similar.similar_groups(docs)
    gone = groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*columns_of(docs))


def _in_mixed_order(docs: DataFrame) -> DataFrame:
    """docs sorted by their places in the schedule, which depend on the rows alone, not on files or partitions.

    Rows with the same id, source and text take the first of their places together; null ids are ids like any other.
    """
    names = fresh(docs, "_id", "_source", "_hash", "_place")
    key, source, digest, place = (F.col(c) for c in names)
    order = mixing.mix(docs).groupBy("_id", "_source", "_hash").agg(F.min(F.struct("_slot", "_start")).alias("_place")).toDF(*names)
    same = (F.xxhash64("doc_id", "text") == digest) & F.col("doc_id").eqNullSafe(key) & F.col("source").cast("string").eqNullSafe(source)
    return docs.join(order, same, "left").orderBy(place, digest, "doc_id").select(*columns_of(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in an order in which the sources keep to their target weights all along.

    Readers of Parquet need not keep the order of its rows, so `pack` finds it again by the same schedule.
    """
    return _in_mixed_order(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, shard_pieces: int = packing.SHARD_PIECES) -> DataFrame:
    """Packs the documents into sequences of the permitted lengths, in runs of the mixed order.

    The mixed order of the sequences is that of (shard_place, bin_place).
    """
    return packing.pack_documents(_in_mixed_order(docs), shard_pieces=shard_pieces, ordered=True)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Language identification has no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
