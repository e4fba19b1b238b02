"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import html, jaccard, lm, media, mixing, packing, quality, secrets, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(_table(spark, sf_dir, "documents"), ["doc_id"])
    failed = quality.passes(F.col("fail_bits"), "v1")
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~failed).alias("base_failed"), quality.passes(F.col("fail_bits")).alias("kept"),
        "fail_bits", "n_lines", "n_capitals", "n_letters", "n_exclaims",
    )


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op1_jpeg_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_texts(_table(spark, sf_dir, "documents"))


def op3_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_toxic_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_shingle_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.archive(_table(spark, sf_dir, "pages")))


QUERIES = {
    "op1_jpeg_store": op1_jpeg_store,
    "op2_quality_ledger": op2_quality_ledger,
    "op3_packed_sequences": op3_packed_sequences,
    "op4_toxic_severity": op4_toxic_severity,
    "op5_gru_scores": op5_gru_scores,
    "op6_mixture": op6_mixture,
    "op7_secret_spans": op7_secret_spans,
    "op8_main_text": op8_main_text,
    "op9_shingle_links": op9_shingle_links,
    "op10_warc_archives": op10_warc_archives,
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline
