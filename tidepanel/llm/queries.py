"""The registered queries of this subpackage, each over the whole of its table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import ans, chunks, hnsw, langid, lines, minhash, mixing, packing, pieces, snapshots, toxicity, variants
from tidepanel.llm import repair as conversation_repair
from tidepanel.llm.common import read
from tidepanel.session import scratch_path


def op1_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page."""
    return langid.identify(spark, read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op2_range_ans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents into token files and read the files back."""
    path = scratch_path(spark, "token-files")
    ans.write_token_files(spark, read(spark, sf_dir, "documents"), path)
    return ans.read_token_files(spark, path)


def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    return snapshots.collapse_and_render(read(spark, sf_dir, "conversations"))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    vectors = read(spark, sf_dir, "embeddings")
    return hnsw.nearest(spark, vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op5_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(spark, read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model that never saw the held-out labels."""
    docs, o = read(spark, sf_dir, "documents"), toxicity.MilOptions()
    model = toxicity.fit(spark, docs, toxicity.training_labels(read(spark, sf_dir, "labels")), o)
    return toxicity.score_documents(docs, model, o.threshold)


def op7_content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return chunks.fingerprint_documents(spark, read(spark, sf_dir, "documents"))


def op8_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate documents."""
    return minhash.near_duplicates(spark, read(spark, sf_dir, "documents"))


def op9_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many of them link to an earlier similar line and go, and what is left of the text."""
    left = lines.dedup_lines(spark, read(spark, sf_dir, "documents"), lines.LineOptions(least_words=1))
    return left.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 ids."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return pieces.count_tokens(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation after faults were planted."""
    damaged = conversation_repair.damage(read(spark, sf_dir, "conversations"))
    return conversation_repair.digests(conversation_repair.repair(spark, damaged))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, the near words of each and the form it stands for."""
    return variants.spelling_variants(spark, read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_fusion,
        op2_range_ans,
        op3_snapshot_collapse,
        op4_hnsw,
        op5_cube_mixing,
        op6_toxicity_mil,
        op7_content_chunks,
        op8_odd_sketches,
        op9_line_join,
        op10_packing,
        op11_token_counts,
        op12_conversation_repair,
        op13_spelling_variants,
    )
}
ORACLES: dict[str, str] = {
    "op3_snapshot_collapse": snapshots.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
    "op13_spelling_variants": variants.SQL,
}
