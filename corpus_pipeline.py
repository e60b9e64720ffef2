"""Corpus pipeline: quality rules, near-duplicates, personal data, source mix, token ids.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that the runner writes as
Parquet and reads again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ohlcraft.llm import bpe, mixing, pii, quality, simhash
from ohlcraft.llm.common import shared_folder, stage, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cut-off rejects go. Null and empty texts have no word and go; an empty
    table stays empty."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.unique_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order. Documents without a word have no size and aren't taken;
    null sources are one source; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and what they decode to: doc_id, lang, source, ids, n_tokens, decoded_sha256 (of the bytes).

    A text whose ids don't decode to its own bytes stops the run. Null and empty texts have no ids; an empty table stays empty."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = bpe.vocabulary(docs, ranks, public_tokenizers.PATTERN, shared_folder(spark))
    return bpe.encode_verified(docs, ranks, public_tokenizers.PATTERN, ("doc_id", "lang", "source"), known)


STAGES = [
    ("quality rules", rules),
    ("simhash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("source mix", mix),
    ("byte-level bpe", token_ids),
]

#: Fingerprints, contextual patterns and BPE are not expressible; tests/llm checks run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written below the shared folder and read again."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, function) in enumerate(STAGES):
        docs = stage(function(spark, docs, sf_dir), folder, f"stage-{k}")
    return docs
