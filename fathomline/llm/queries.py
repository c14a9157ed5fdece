"""Queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

import public_tokenizers

from fathomline.llm import url_filter
from fathomline.llm.cotraining import quality_classifier
from fathomline.llm.fingerprints import fingerprints
from fathomline.llm.lm import score_texts
from fathomline.llm.minhash import near_duplicates
from fathomline.llm.mixing import mix
from fathomline.llm.packing import best_fit_packing
from fathomline.llm.quality_rules import quality_rules
from fathomline.llm.storage import bound_batches
from fathomline.llm.substring import repeated_passages
from fathomline.llm.token_files import token_files

#: Vocabulary file; read from where it is installed.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ORACLE_SQL = {"op8_url_filter": url_filter.SQL}


def table(spark, sf_dir: str, name: str):
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark, sf_dir):
    return best_fit_packing(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_quality_classifier(spark, sf_dir):
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


def op7_language_model(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


def op8_url_filter(spark, sf_dir):
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op9_token_files(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"), VOCABULARY)


def op10_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("source")


def queries() -> dict:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}
