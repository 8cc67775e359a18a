"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidevec.llm import decontaminate, html_text, langid, licenses, lines, ogg, packing, simhash, suffixes, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All license detections of documents: words, base phrases, labels and score. Null texts are empty."""
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("detections")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens. Null texts are the end id alone; repeated rows are all packed."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles and components within 3 bits. Null and empty texts have fingerprint zero and link like any other."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from labels of the rows that are not held out. Null and empty texts get the score of no voter firing."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~_held_out(4, 2))
    found = toxicity.score(docs, model)
    return found.select("doc_id", _held_out(4, 2).alias("held_out"), "score", "predicted", "n_voters")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in an Ogg container and read back. Null texts are empty and padded to 64 bytes."""
    return ogg.round_trip(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; empty for null or empty html and for pages without one."""
    return html_text.extract(_table(spark, sf_dir, "pages"), url_col="url").select("page_id", "url", "text", "n_chars")


def _held_out(modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves this remainder; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the rows that are not held out; und for texts without a letter."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, ~_held_out(3, 1))
    found = langid.identify(docs, model)
    return found.select("doc_id", _held_out(3, 1).alias("held_out"), "lang_pred", "score", "distance", "rejected")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that overlap. Null and empty texts overlap nothing."""
    return decontaminate.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier place has, but for one edit. Null texts stay null."""
    return lines.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of 100-byte strings that start earlier. Null texts are empty."""
    return suffixes.dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_media_columns": op5_media_columns,
    "op6_html_extraction": op6_html_extraction,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
}

ORACLES: dict[str, str] = {
    "op6_html_extraction": html_text.oracle(),
    "op8_decontamination": decontaminate.oracle(),
    "op9_line_dedup": lines.oracle(),
    "op10_suffix_dedup": suffixes.oracle(),
}
