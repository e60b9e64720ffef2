"""Queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, media, mixing, packing, pii, quality, rollup, secrets, simhash, wrapper
from .common import WORD, join_hot, shared_folder, stage, table


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


VERSION = "byte_bpe_50k"


def _copies(docs: DataFrame) -> DataFrame:
    """(doc_id, __t, ...) -> adds copy: whether an earlier document has the same text, whose digest of 128 bits is __t.

    Null doc_ids are no copies; an empty table gives an empty table. Only texts that occur more than once meet the join,
    and a frequent one is spread over its parts."""
    same = docs.groupBy("__t").agg(F.min("doc_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    many = docs.select("doc_id", "__t").distinct().where("doc_id is not null")
    later = join_hot(many, same, ["__t"], F.xxhash64("doc_id")).where(F.col("doc_id") > F.col("__first")).select("doc_id", "__t", F.lit(True).alias("copy"))
    return docs.join(later, ["doc_id", "__t"], "left").withColumn("copy", F.coalesce("copy", F.lit(False))).drop("__t")


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("__t", F.md5(F.coalesce("text", F.lit(""))))
    folder = shared_folder(spark)
    counts = bpe.count_tokens(docs, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "source", "lang", "__t"))
    counts = stage(_copies(stage(counts, folder, "counts")).withColumn("version", F.lit(VERSION)), folder, "marked")
    ledger = rollup.Ledger(spark, f"{folder}/ledger")
    rollup.history(ledger, counts)
    return ledger.totals()


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of op1 with two tokenizer versions that SQL can count: words and UTF-8 bytes."""
    t = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.md5(t).alias("__t"), F.regexp_count(t, F.lit(WORD)).alias("words"), F.octet_length(t).alias("bytes")
    )
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("version"), F.col(c).cast("long").alias("n_tokens")) for c in ("words", "bytes")]))
    folder = shared_folder(spark)
    counts = _copies(stage(docs, folder, "counts")).select("doc_id", "source", "lang", "copy", each.alias("v"))
    counts = counts.select("doc_id", "source", "lang", "copy", "v.version", "v.n_tokens")
    ledger = rollup.Ledger(spark, f"{folder}/ledger")
    rollup.history(ledger, counts)
    return ledger.totals()


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = bpe.vocabulary(docs, RANKS, public_tokenizers.PATTERN, shared_folder(spark))
    return bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN, known)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # words are counted once and written; the totals and the positions both read them
    sizes = stage(mixing.sized(docs).select("doc_id", "source", "size"), shared_folder(spark), "sizes")
    out = mixing.mix(sizes, counted=True).withColumn("position", F.try_element_at("turns", F.lit(1))["position"])
    return mixing.by_position(out.select("doc_id", "size", "source_size", "target", "taken", "position"))


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op5 that SQL can check: each source's size and target."""
    sizes = mixing.sized(table(spark, sf_dir, "documents").select("source", "text")).groupBy("source").agg(F.sum("size").alias("source_size"))
    return mixing.targets(sizes).select("source", "source_size", F.round("target", 4).alias("target"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = f"{shared_folder(spark)}/ids"
    packing.write_blocks(table(spark, sf_dir, "documents"), TOKENIZER, files, END_ID)
    return packing.read_documents(spark, files)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_texts(table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    # the measures of all documents are written once and serve the cut-offs and the verdicts
    m = quality.measured(docs).select("doc_id", F.col("lang").alias("__stratum"), "q")
    m = stage(m, shared_folder(spark), "measures")
    out = quality.verdicts(m, quality.limits(m, table(spark, sf_dir, "labels")))
    counts = [f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.select("doc_id", *counts, "base_failed", "kept")


QUERIES = {
    "op1_token_rollup": op1_token_rollup,
    "op2_media": op2_media,
    "op3_bpe": op3_bpe,
    "op4_secrets": op4_secrets,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_packed_ids": op7_packed_ids,
    "op8_quality": op8_quality,
    "op9_main_text": op9_main_text,
    "op10_simhash": op10_simhash,
    "token_rollup_words": token_rollup_words,
    "mixing_targets": mixing_targets,
}

#: Cut-offs as in quality.GRID, tail and correction as in quality.cutoffs.
_GRID_ROWS = ", ".join(f"('{name}', {c}::DOUBLE)" for name, cs in quality.GRID.items() for c in cs)
_POINTS = sum(map(len, quality.GRID.values()))

ORACLES: dict[str, str] = {
    # rounds of resharing what is above twice a source's size, until none is
    "mixing_targets": r"""
WITH RECURSIVE z AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS n FROM documents GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM z),
r AS (SELECT 0 AS step, []::BIGINT[] AS full_ UNION ALL
      SELECT step + 1, list_sort(list_concat(full_, over_)) FROM (SELECT step, full_, (SELECT list(k) FROM w WHERE NOT list_contains(full_, k) AND w * (SELECT 1.5 * sum(n) - 2 * coalesce(sum(n) FILTER (WHERE list_contains(full_, k)), 0) FROM w)
             / (SELECT sum(w) FROM w WHERE NOT list_contains(full_, k)) > 2 * n) AS over_ FROM r) WHERE len(over_) > 0),
f AS (SELECT full_ FROM r ORDER BY step DESC LIMIT 1)
SELECT source, n AS source_size, round(CASE WHEN list_contains(full_, k) THEN 2.0::DOUBLE * n ELSE w * (SELECT 1.5::DOUBLE * sum(n) - 2 * coalesce(sum(n) FILTER (WHERE list_contains(full_, k)), 0) FROM w, f)
       / (SELECT sum(w) FROM w, f WHERE NOT list_contains(full_, k)) END, 4) AS target FROM w, f
""",
    "token_rollup_words": r"""
WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS x FROM documents),
kept AS (SELECT *, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
v AS (SELECT source, lang, 'words' AS version, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) + 1 AS n FROM kept WHERE doc_id = first
      UNION ALL SELECT source, lang, 'bytes', strlen(x) + 1 FROM kept WHERE doc_id = first)
SELECT source, lang, version, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM v GROUP BY ALL
""",
    "op8_quality": rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM g) WHERE c > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS j FROM d, (SELECT unnest(range(0, 5)) AS k)) GROUP BY r),
q AS (SELECT t.r, doc_id, lang, len(ws)::BIGINT AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls) AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM t JOIN w USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM q),
s AS (SELECT r, lang, 'symbol_share' AS score, n_symbols::DOUBLE / nullif(n_words, 0) AS v FROM b
      UNION ALL SELECT r, lang, 'dup_line_share', n_dup_lines::DOUBLE / nullif(n_lines, 0) FROM b
      UNION ALL SELECT r, lang, 'repeat_share', n_repeat_words::DOUBLE / nullif(n_words, 0) FROM b
      UNION ALL SELECT r, lang, 'long_words', word_chars::DOUBLE / nullif(n_words, 0) FROM b
      UNION ALL SELECT r, lang, 'short_words', -word_chars::DOUBLE / nullif(n_words, 0) FROM b),
grid(score, cutoff) AS (VALUES {_GRID_ROWS}),
good AS (SELECT s.* FROM s JOIN b USING (r) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tests AS (SELECT lang, score, cutoff, count(*) AS n, count(*) FILTER (WHERE v > cutoff) AS k FROM good JOIN grid USING (score) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k >= n * {quality.RISK} THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i:
        exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({quality.RISK}) + (n - i) * ln(1 - {quality.RISK})))) END AS p,
        (SELECT count(DISTINCT coalesce('s' || lang, '')) FROM tests) AS strata FROM tests),
cut AS (SELECT lang, score, min(cutoff) AS cutoff FROM p WHERE p * strata * {_POINTS} <= {quality.ALPHA} GROUP BY lang, score),
bad AS (SELECT DISTINCT r FROM s JOIN cut ON s.score = cut.score AND s.lang IS NOT DISTINCT FROM cut.lang WHERE v > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM bad) AS kept FROM b
""",
}
