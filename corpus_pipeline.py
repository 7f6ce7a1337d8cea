"""Corpus pipeline: documents through the stages of STAGES, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import lines, minhash, mixing, packing, toxicity
from tidepanel.llm.common import read, staged


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model of the labels that may be learned from.

    Rows without text score 0 and stay; rows without doc_id are scored like others; repeated rows stay; an empty table or one without
    labelled rows gives a model of the bias alone."""
    o = toxicity.MilOptions()
    model = toxicity.fit(spark, docs, toxicity.training_labels(read(spark, sf_dir, "labels")), o)
    return toxicity.reject_toxic(docs, model, o.threshold)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that resemble an earlier one; n_chars follows the text.

    The order is doc_id (missing ones last), then line; of equal lines the first stays. A missing text stays missing, with a missing
    n_chars; repeated rows are one document and stay; an empty table stays empty."""
    left = lines.dedup_lines(spark, docs, lines.LineOptions(least_words=1)).select(*docs.columns)
    return left.withColumn("n_chars", F.length("text").cast("long"))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id, in one row (the smallest text, if rows share it).

    Documents without words are their own group; rows without doc_id all stay."""
    return minhash.one_of_each_group(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (twice at most).

    A missing source is one source, the last; documents without words weigh nothing; draws are hashed from ids,
    so reruns agree and repeated rows share a draw; an empty table stays empty."""
    return mixing.repeat_rows(mixing.mix(spark, docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 ids, one row per piece of a document. A missing text is the end id alone; repeated rows are packed as
    often as they occur; an empty table gives no rows."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("near-dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Training, similarity joins and dynamic programming have no SQL form; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(spark, stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
