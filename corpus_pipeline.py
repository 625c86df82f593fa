"""Corpus pipeline: from raw documents to the token ids of a deduplicated mix.

Each stage takes all documents that the one before it kept and returns documents again, the last one their ids. Columns
that the operators know nothing of go through unchanged, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import classifier, common, mixing, neardup, pieces
from parchment.llm.quality_rules import quality_rules

#: SQL has none of the models, hashes and lattices of the stages; tests compare them with brute force instead.
ORACLE_SQL = None


def _packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all but the text in one more, where no operator takes them for its own."""
    return docs.select(*names, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("packed_row"))


def _unpacked(packed: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    own = lambda c: F.col("text") if c == "text" else F.col(f"packed_row.`{c}`")
    return packed.select(*[changed.get(c, own(c)).alias(c) for c in columns])


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't depleted, without the lines that are frequent in their source.

    Null and empty texts fail the rules and go. A null source is a source of its own. Repeated rows are judged alike, and
    count once where lines are counted. Of no documents none are left.
    """
    kept = quality_rules(_packed(docs, "text", "source")).where("kept")
    clean = F.col("clean_text")
    return _unpacked(kept, docs.columns, text=clean, n_chars=F.length(clean).cast("long"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, trained on the labelled ones among them, finds good.

    Null texts are scored as empty ones. Rows without doc_id have no label and are scored like all others; repeated rows
    are scored alike. Without labels every score is 0.5, so that all documents stay.
    """
    model = classifier.train(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = classifier.classify(_packed(docs, "doc_id", "text"), model).where("predicted = 1")
    return _unpacked(good, docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Null and empty texts resemble nothing and stay, one for each doc_id; so do all rows without doc_id. Rows that repeat a
    doc_id and a text are one document.
    """
    return _unpacked(neardup.drop_near_duplicates(_packed(docs, "doc_id", "text")), docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the order of the mix and as often as it takes them, the last one of a source cut where its target is
    reached.

    Null and empty texts have no words, so the mix takes none of them. A null source is the last one. Rows that repeat a
    doc_id, source and size are taken alike.
    """
    mixed = mixing.mix_documents(_packed(docs, "doc_id", "text", "source"))
    return _unpacked(mixed, docs.columns, n_chars=F.length("text").cast("long"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best ids of each document of the mix, and what its N best segmentations score.

    Null and empty texts have no ids. Every row is encoded for itself, in the order in which it comes.
    """
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("near-duplicates", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; what a stage returns is written before the next reads it.
    What this run wrote and nothing reads any more is deleted from the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with common.noting_folders() as own:
        for _, stage in STAGES[:-1]:
            docs = common.saved(stage(spark, docs, sf_dir))
            common.discard(spark, own[:-1])
            del own[:-1]
        return STAGES[-1][1](spark, docs, sf_dir)
