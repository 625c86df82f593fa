"""Queries of this subpackage over the tables, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from parchment.llm import classifier, language_model, mixing, oracle, pieces, token_file, warc
from parchment.llm.divergence import source_divergences
from parchment.llm.fingerprint import fingerprint_documents
from parchment.llm.common import saved
from parchment.llm.neardup import near_duplicates
from parchment.llm.packing import pack_documents
from parchment.llm.periodic import document_runs
from parchment.llm.quality_rules import quality_rules
from parchment.llm.url_filter import RULES_SCHEMA, filter_urls
from parchment.sources.tables import table

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_quality_rules(spark, sf_dir):
    judged = quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_words_left")


def op2_mixing(spark, sf_dir):
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


def op3_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, RULES_SCHEMA)
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_language_model(spark, sf_dir):
    return language_model.score_documents(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.train(docs, table(spark, sf_dir, "labels"))
    return classifier.classify(docs, model).select("doc_id", "held_out", "score", "predicted")


def op6_fingerprints(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_token_file(spark, sf_dir):
    return token_file.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_sentencepiece(spark, sf_dir):
    encoded = pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "n_units", "n_tokens", F.crc32("ids").alias("ids_crc32"), "score", "nbest", "decoded_equal")


def op9_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark, sf_dir):
    archives = saved(warc.write_archives(warc.mark_revisits(table(spark, sf_dir, "pages"))))
    normal = saved(warc.normalise_archives(archives))
    return warc.read_archives(normal, saved(warc.sidecar_index(normal))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op11_source_divergence(spark, sf_dir):
    return source_divergences(table(spark, sf_dir, "documents"))


def op12_packing(spark, sf_dir):
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op13_periodic_runs(spark, sf_dir):
    return document_runs(table(spark, sf_dir, "documents"), edited=True)


def queries():
    own = {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return oracle.SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
