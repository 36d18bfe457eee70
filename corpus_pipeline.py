"""A training-data pipeline over ``documents``: each stage applies one operator to all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again as the
next one's docs. All stages but the last return the columns of documents; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, lines, mixing, near_text, pieces, vocab
from tidemark.llm.common import Scratch

#: Least posterior probability of the language a document is kept with.
MIN_SCORE = 0.5


def _back(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those no learned language is likely for; lang takes the prediction.

    The model is learned from the labelled documents; where none is labelled, nothing can be judged and all
    documents with a letter stay.
    """
    model = language.learn(docs.select("text", "lang"), vocab.load())
    if not model.langs:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    judged = language.identify(docs, model, keep=docs.columns, prefix="_tm_")
    return _back(judged.where((F.col("_tm_lang_pred") != language.UND) & (F.col("_tm_score") >= MIN_SCORE)).withColumn("lang", F.col("_tm_lang_pred")), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated multi-line chunks; a document of which nothing but white space is left goes."""
    cut = lines.dedup_lines(docs, "_tm_")
    cut = cut.where((F.col("_tm_n_removed") == 0) | F.regexp_like("text", F.lit(r"\S")))
    return _back(cut.withColumn("n_chars", F.when(F.col("_tm_n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))), docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with a five-word-shingle similarity of 0.8 or more."""
    return near_text.dedup(docs, 5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix uses it."""
    mixed = mixing.mix(docs, F.array("source"), mixing.seeded_key(), prefix="_tm_").where("_tm_taken > 0")
    return _back(mixed.withColumn("_tm_use", F.explode(F.sequence(F.lit(1).cast("long"), "_tm_uses"))), docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of each document, with the checksums that show decoding is exact."""
    return pieces.encode(docs, vocab.load(), "doc_id", keep=["doc_id", "lang", "source"])


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language ID", keep_known_language),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", keep_one_of_near_copies),
    ("mixing", mix_sources),
    ("SentencePiece", encode_pieces),
]
#: Language ID, near-dedup by signatures and sampled pieces have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
