"""Registered queries of this subpackage, with production parameters, and
their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as _exact
from . import knn as _knn
from . import langid as _langid
from . import line_dedup as _lines
from . import lm as _lm
from . import mixing as _mixing
from . import negatives as _negatives
from . import packing as _packing
from . import resampling as _resampling
from . import simhash as _simhash
from . import substring_dedup as _repeats
from . import url_filter as _urls
from . import window_packing as _windows
from .common import fold, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens, by best-fit decreasing with certified bounds."""
    rows = _packing.pieces(table(spark, sf_dir, "documents"))
    return _packing.pack(rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, longest rule and verdict of every page; a null url has an empty host and path and the trees' verdict."""
    return _urls.judge_urls(table(spark, sf_dir, "pages"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer inner products of every 20th vector with all others."""
    return _knn.top_k(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all texts under a model of four fifths of them.  A null doc_id has no remainder:
    such a row is scored, not learned from, and its held_out is null."""
    out = _lm.score(table(spark, sf_dir, "documents"), fold(F.col("doc_id")) != 1)
    held_out = fold(F.col("doc_id")) == 1
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mix of sources by shares to the power 0.7."""
    return _mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source")).drop("row")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and the hash of what is left, of every document."""
    out = _lines.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and calibrated score of every text.  A null doc_id has no remainder: such a row is
    judged, not learned from, and its held_out is null."""
    out = _langid.identify(table(spark, sf_dir, "documents"), fold(F.col("doc_id")) != 0)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and the smallest doc_id linked to it by 3 or fewer differing bits."""
    return _simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal normalised texts of every document; the row with the smallest doc_id stays."""
    return _exact.exact_dedup(table(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document covered by 200-byte strings that start anywhere else, and the hash of the rest."""
    out = _repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of an anchor's five positives, over all
    ``embeddings``; every seventh id's label is moved on by one first."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return _negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens."""
    return _windows.pack(table(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of the ``documents``, drawn to resemble the ``benchmark``."""
    return _resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_url_filter": op2_url_filter,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_pfair_mixing": op5_pfair_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_language_id": op7_language_id,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_window_packing": op12_window_packing,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_top_k": _knn.SQL,
    "op9_exact_dedup": _exact.SQL,
    "op11_hard_negatives": _negatives.SQL,
}
