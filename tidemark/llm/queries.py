"""The contract queries opN_<name>: each applies its operator to a whole table of the driver's data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import curves, language, licenses, lines, mixing, near_text, near_vectors, oracles, pieces, sharding, urls, vocab
from tidemark.llm.common import utf8_bytes

SHARDS = 8
#: op6: (verdict, host, path).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*cols) if cols else df


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: counts differ by at most one. Row numbers follow (doc_id, size, CRC)."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    narrow = docs.select("doc_id", (utf8_bytes(F.col("text")) + 1).alias("size"), F.crc32("text").alias("text_crc32"))
    out = sharding.shard_rows(narrow, ["doc_id", "size", "text_crc32"], SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, by the contract."""
    return near_text.components(_read(spark, sf_dir, "documents", "doc_id", "text"), 4).drop("at")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    docs = docs.withColumn("held_out", held)
    model = language.learn(docs.where("not held_out").select("text", "lang"), vocab.load())
    return language.identify(docs.select("doc_id", "held_out", "text"), model)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces sampled, their CRC, the CRCs of the text and of the decoded text, and whether they agree."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return pieces.encode(docs, vocab.load(), "doc_id", keep_ids=False)


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the document its path's first number names: bad if toxic or of quality 0."""
    pages = _read(spark, sf_dir, "pages", "page_id", "url")
    _, path = urls.host_and_path(F.col("url"))
    marks = _read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_doc")).agg(F.max((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    doc = F.expr("try_cast(regexp_extract(_path, '([0-9]+)', 1) as bigint)")
    labelled = pages.withColumn("_path", path).withColumn("_doc", doc).join(marks, "_doc", "left")
    return urls.judge(labelled.select("page_id", "url", "bad"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "source")
    out = mixing.mix(docs, F.array("source"), mixing.seeded_key())
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.links(_read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those removed, and the MD5 of the text that is left."""
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: how many templates it holds, and their names."""
    out = licenses.annotate(_read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_minhash_dedup, op3_language_id, op4_sentencepiece, op5_ann, op6_url_filter, op7_mixing, op8_embedding_dedup, op9_line_dedup, op10_license_scan)
}
ORACLES = oracles.sql(URL_RULES)
