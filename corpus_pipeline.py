"""Corpus pipeline: the stages that turn ``documents`` into packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last
return the columns of ``documents``.  Null texts and repeated rows pass the
stages as their operators define; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventclime.llm import langid, line_dedup, mixing, packing, simhash
from eventclime.llm.common import fold, in_order, table, written

MIN_SCORE = 0.4     # least calibrated probability of the predicted language
RUN_DOCS = 2_000    # documents of the mix that are packed together


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language is not even probable, go;
    the others stay as they are.  Learns from four fifths of the documents."""
    judged = langid.identify(docs, fold(F.col("doc_id")) != 0).select(
        F.col("doc_id").alias("judged"), ((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)).alias("good"))
    # rows that repeat an id stay if one of their texts does
    good = judged.where("good").select("judged").distinct()
    return docs.join(good, docs["doc_id"].eqNullSafe(good["judged"]), "left_semi")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go (but for the first);
    the documents stay, with ``n_chars`` of what is left."""
    out = line_dedup.line_dedup(docs)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document stays whose id names it."""
    groups = simhash.simhash_dedup(docs)
    keep = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["kept"]), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered so that the sources come in their target weights
    (shares of documents to the power 0.7); when a source has no document
    left, the others go on in the ratio of their weights."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens that follow the mix: one row per piece
    and its place, the document's ``rank`` in the mix, and the sequence's
    ``position`` (the least rank in it).

    The mix is the order in which the last stage's rows were written.  Runs of
    ``RUN_DOCS`` documents are packed together, so a sequence holds documents
    that are near each other in the mix (but for those that runs with gaps
    exchange), and sequences by ``position`` have the mix's shares.
    """
    ranked = written(in_order(docs, "rank").select("rank", "doc_id", "text"), "pipeline-ranked")
    rows = packing.pieces(ranked, id_col="rank").withColumnRenamed("doc_id", "rank")
    run = F.expr(f"rank div {RUN_DOCS}")
    packed = packing.pack(rows.withColumn("ids_crc32", F.crc32("ids")).drop("ids").withColumn("run", run), run=F.col("run")).drop("run")
    packed = packed.withColumn("position", F.min("rank").over(Window.partitionBy("sequence_id")))
    return packed.join(ranked.select("rank", "doc_id"), "rank")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: The stages train models, link documents by fingerprints and pack: not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
