"""Quality rules with risk-controlled thresholds, in DataFrame expressions only.

Per text the base measures and five scores are computed in one pass. A score rejects a document when it
exceeds the cut-off of the document's stratum (language). Cut-offs come from labelled documents: for every
stratum, score and cut-off of a fixed grid, the exact binomial tail P(Bin(n, RISK) <= k) of k rejected among
n good documents is the p-value of "good documents are rejected at a rate of RISK or more". A cut-off counts
where the p-value is at most ALPHA divided by the number of all tests made (Bonferroni over strata, scores and
grid), and the strictest such cut-off of a stratum and score is used. RISK is the allowed rate of a stratum shared
equally among the scores, so that a stratum's false rejections stay below MAX_RISK with probability 1 - ALPHA.
A stratum without enough labels has no certified cut-off and only the base rule rejects there.

Defined results: null or word-less text has zero counts and fails the base rule; null language is a stratum
of its own; labels with null fields, of unknown documents or repeated are ignored or count once per row; rows
that share a doc_id are each judged by their own text; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, shared_folder, stage, text_of

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

MAX_RISK = 0.05
ALPHA = 0.05
#: Score -> cut-offs, strictest first. A document is rejected when its score is above the cut-off.
GRID: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.1, 0.25, 0.5, 1.0),
    "dup_line_share": (0.2, 0.3, 0.5, 0.7),
    "repeat_share": (0.05, 0.1, 0.15, 0.2),
    "long_words": (10.0, 12.0, 15.0, 20.0),
    "short_words": (-2.0, -1.75, -1.5, -1.25),
}
RISK = MAX_RISK / len(GRID)


def _pairwise(a: Column, lag: int, other: Column) -> Column:
    """Hashes of a[i] and other[i + lag], for all i that have both."""
    n = F.greatest(F.size(other) - F.lit(lag), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(other, F.lit(1 + lag), n), lambda x, y: F.xxhash64(x, y))


def measured(docs: DataFrame) -> DataFrame:
    """docs(text, ...) -> all columns of docs and one struct column `q` with the measures."""
    t = text_of()
    df = docs.withColumn("__words", F.array_remove(F.split(t, SPACE), ""))
    df = df.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("__h", F.transform("__words", lambda x: F.xxhash64(x)))
    # hashes of windows of 2, 4 and 5 words, each from two of the former
    df = df.withColumn("__h2", _pairwise(F.col("__h"), 1, F.col("__h")))
    df = df.withColumn("__h4", _pairwise(F.col("__h2"), 2, F.col("__h2")))
    df = df.withColumn("__h5", _pairwise(F.col("__h4"), 4, F.col("__h")))
    some = F.size(F.array_distinct("__h5")) < F.size("__h5")
    df = df.withColumn(
        "__sorted", F.when(some, F.sort_array(F.transform("__h5", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    )
    n = F.size("__sorted") - 1
    twice = F.zip_with(
        F.slice("__sorted", F.lit(1), n),
        F.slice("__sorted", F.lit(2), n),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    df = df.withColumn("__at", F.when(F.col("__sorted").isNotNull(), F.sort_array(F.array_distinct(F.flatten(twice)))))
    m = F.size("__at") - 1
    gaps = F.zip_with(F.slice("__at", F.lit(1), m), F.slice("__at", F.lit(2), m), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    repeated = F.when(F.col("__at").isNull(), 0).otherwise(F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x)).cast("long")
    counts = F.struct(
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
    )
    return df.withColumn("q", counts).select(*docs.columns, "q")


def scores() -> dict[str, Column]:
    """The scores from the measures; those of a word-less text are null and reject nothing."""
    words = F.when(F.col("q.n_words") > 0, F.col("q.n_words")).cast("double")
    lines = F.when(F.col("q.n_lines") > 0, F.col("q.n_lines")).cast("double")
    mean = F.col("q.word_chars") / words
    return {
        "symbol_share": F.col("q.n_symbols") / words,
        "dup_line_share": F.col("q.n_dup_lines") / lines,
        "repeat_share": F.col("q.n_repeat_words") / words,
        "long_words": mean,
        "short_words": -mean,
    }


def base_failed() -> Column:
    return (F.col("q.n_words") < MIN_WORDS) | (100 * F.col("q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q.n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k): each term from the one before, as logarithms."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("t"), (acc["s"] + F.exp(term)).alias("s"))

    start = F.struct(first.alias("t"), F.exp(first).alias("s"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda acc: acc["s"])


def cutoffs(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """judged(doc_id, __stratum, q), labels(doc_id, quality) -> (stratum, score, cutoff): the certified ones.

    Only counts for each stratum, score and grid point meet; they come from all labelled documents.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("__id"))
    held = judged.join(good, F.col("doc_id") == F.col("__id"), "left_semi").where(~base_failed())
    grid = F.array(
        *[
            F.struct(F.lit(name).alias("score"), F.lit(float(c)).alias("cutoff"), F.coalesce(s > c, F.lit(False)).alias("out"))
            for name, s in scores().items()
            for c in GRID[name]
        ]
    )
    tests = (
        held.select(F.col("__stratum").alias("stratum"), F.explode(grid).alias("g"))
        .groupBy("stratum", "g.score", "g.cutoff")
        .agg(F.count("*").alias("n"), F.count_if("g.out").alias("k"))
    )
    points = sum(map(len, GRID.values()))
    # windows over all rows: one for each stratum and grid point
    tests = tests.withColumn("__rank", F.dense_rank().over(Window.orderBy("stratum")))
    tested = tests.withColumn("strata", F.max("__rank").over(Window.partitionBy()))
    # a tail is over 0.3 where k reaches n * RISK: such a cut-off is out without summing
    p = F.when(F.col("k") >= F.col("n") * RISK, 1.0).otherwise(binomial_tail(F.col("n"), F.col("k"), RISK))
    return (
        tested.withColumn("p", p)
        .where(F.col("p") * F.col("strata") * points <= ALPHA)
        .groupBy("stratum", "score")
        .agg(F.min("cutoff").alias("cutoff"))
    )


def limits(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each stratum with a certified cut-off: (__of, one column for each score)."""
    certified = cutoffs(judged, labels)
    return certified.groupBy(F.col("stratum").alias("__of")).agg(
        *[F.max(F.when(F.col("score") == name, F.col("cutoff"))).alias(f"__{name}") for name in GRID]
    )


def verdicts(measures: DataFrame, limit: DataFrame) -> DataFrame:
    """Adds base_failed and kept; measures has __stratum and q. Strata are joined null-safely."""
    over = [F.coalesce(s > F.col(f"__{name}"), F.lit(False)) for name, s in scores().items()]
    bad = over[0]
    for x in over[1:]:
        bad = bad | x
    joined = measures.join(limit, F.col("__stratum").eqNullSafe(F.col("__of")), "left")
    out = joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~bad)
    return out.drop("__stratum", "__of", *[f"__{name}" for name in GRID])


OWN = ("q", "base_failed", "kept")


def _judged(docs: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    """(__doc struct of all columns of docs, doc_id, q, base_failed, kept).

    The measured rows are written once: a filter on kept would else be pushed below the measures and repeat them.
    """
    folder = shared_folder(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), "doc_id", "text", F.col(stratum).alias("__stratum"))
    m = stage(measured(rows).drop("text"), folder, "measures")
    limit = stage(limits(m.select("doc_id", "__stratum", "q"), labels), folder, "limits")
    return verdicts(m, limit)


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """docs(doc_id, text, stratum, ...) -> the columns of docs, q, base_failed and kept; the last three replace others of their names."""
    return _judged(docs, labels, stratum).select(*[f"__doc.`{c}`" for c in docs.columns if c not in OWN], *OWN)


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    return _judged(docs, labels, stratum).where("kept").select("__doc.*")
