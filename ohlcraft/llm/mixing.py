"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) get the weights in turn; together they get SHARE of all words; no
source gets more than MAX_REPEAT times its own words, and what that leaves over goes to the others by weight. The
final targets come in closed form from the sources in order of cap per weight (water filling).

Documents of a source stand in a fixed pseudo-random order. The words taken are the first target words of that order,
repeated: a document is taken once or twice whole, and the one at the edge in part. Each source has a linear weight
schedule over training time with mean 1; its integral is the cumulative demand, and inverting it at a document's
cumulative words gives the training position, by which documents are range-sorted.

A source may hold any share of the rows: running totals are made in two levels, over hash buckets of a source and
inside a bucket, so the largest group is a BUCKETS-th part of the largest source.

Defined results: null or word-less text has size 0 and is taken 0 times; null source is a source of its own; null
doc_id is an id like any other; repeated rows count each; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEAT = 2
BUCKETS = 4096
#: Weight at the start and at the end of training, as shares of the mean weight, in turn as WEIGHTS.
SCHEDULES = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))


def sized(docs: DataFrame) -> DataFrame:
    """Adds size long: the number of words."""
    return docs.withColumn("size", F.regexp_count(text_of(), F.lit(WORD)).cast("long"))


def targets(source_sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> adds target double and the schedule's ends a, b. One row for each source, so that
    the windows over all rows see one row for each source only."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    at = F.element_at(F.array(*[F.struct(*[F.lit(float(x)) for x in (w, *s)]) for w, s in zip(WEIGHTS, SCHEDULES)]), (turn + 1).cast("int"))
    df = source_sizes.withColumn("__p", at).select(
        "source", "source_size", F.col("__p.col1").alias("w"), F.col("__p.col2").alias("a"), F.col("__p.col3").alias("b"),
        (F.col("source_size") * float(MAX_REPEAT)).alias("cap"),
    )
    order = (F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last()
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    df = df.withColumn("__total", F.sum("source_size").over(whole) * SHARE)
    df = df.withColumn("__level", (F.col("__total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward))
    # the first source below its cap sets the level for itself and all after it
    fits = F.when(F.col("__level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("o"), F.col("__level").alias("l")))
    df = df.withColumn("__set", F.min(fits).over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("__set.l") * F.col("w"), F.col("cap")))
    return df.select("source", "source_size", target.alias("target"), "a", "b")


def _clip(x: Column, most: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(x, most))


def _position(words_before: Column, words: Column, total: Column) -> Column:
    """Training time in [0, 1] at which the demand a*t + (b - a)*t*t/2 reaches the middle of the words."""
    u = (words_before + words / 2.0) / total
    return 2.0 * u / (F.col("__a") + F.sqrt(F.col("__a") * F.col("__a") + 2.0 * (F.col("__b") - F.col("__a")) * u))


OWN = ("source_size", "target", "taken", "turns")


def mix(docs: DataFrame, counted: bool = False) -> DataFrame:
    """docs(doc_id, source, text, ...) -> all columns, size, source_size, target, taken and
    turns array<struct<turn int, words long, position double>>, one for each time a document is taken; these replace
    other columns of their names. counted: docs holds size (see sized) and needs no text."""
    docs = docs.drop(*OWN) if counted else docs.drop("size", *OWN)
    rows = docs if counted else sized(docs)
    h = F.xxhash64(F.col("doc_id"), F.col("size"), F.lit(7))  # with the size, so that null ids aren't all of one bucket
    bucket = F.shiftrightunsigned(h, 64 - (BUCKETS.bit_length() - 1))
    # null-free keys: the join and the window then share one exchange of the documents
    key, at = ["__s", "__none"], {"__s": F.coalesce("source", F.lit("")), "__none": F.col("source").isNull()}
    rows = rows.withColumns(at | {"__h": h, "__bucket": bucket})
    parts = rows.groupBy(*key, "__bucket").agg(F.sum("size").alias("__n"))
    source = F.when(~F.col("__none"), F.col("__s")).alias("source")
    goal = targets(parts.groupBy(*key).agg(F.sum("__n").alias("source_size")).select(source, "source_size")).withColumns(at)
    in_source = Window.partitionBy(*key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("__first", F.coalesce(F.sum("__n").over(in_source), F.lit(0).cast("long")))
    placed = placed.join(goal.withColumnsRenamed({"a": "__a", "b": "__b"}).drop("source"), key).drop("__n")
    joined = rows.join(placed, [*key, "__bucket"])
    inside = Window.partitionBy(*key, "__bucket").orderBy("__h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = joined.withColumn("__at", F.col("__first") + F.coalesce(F.sum("size").over(inside), F.lit(0).cast("long")))
    goal_words = F.round("target").cast("long")
    for k in range(MAX_REPEAT):
        start = F.col("__at") + k * F.col("source_size")
        df = df.withColumn(f"__w{k}", _clip(goal_words - start, F.col("size")))
    turns = [
        F.struct(
            F.lit(k + 1).alias("turn"),
            F.col(f"__w{k}").alias("words"),
            _position(F.col("__at") + k * F.col("source_size"), F.col(f"__w{k}"), F.greatest(goal_words, F.lit(1))).alias("position"),
        )
        for k in range(MAX_REPEAT)
    ]
    df = df.withColumn("taken", sum((F.col(f"__w{k}") for k in range(1, MAX_REPEAT)), F.col("__w0")))
    df = df.withColumn("turns", F.filter(F.array(*turns), lambda t: t["words"] > 0))
    return df.select(*docs.columns, *([] if counted else ["size"]), *OWN)


def by_position(df: DataFrame, position: str = "position") -> DataFrame:
    """Range-sorted by training position; ties by doc_id."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, position, "doc_id").sortWithinPartitions(position, "doc_id")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The training order: a row of docs for each time a document is taken, whole documents only (a document taken in
    part counts as taken when that part is half of it or more), range-sorted by position."""
    rows = sized(docs.select(F.struct(*docs.columns).alias("__doc"), "doc_id", "source", "text")).drop("text")
    taken = mix(rows, counted=True).select("__doc", "doc_id", "size", F.explode("turns").alias("__t"))
    taken = taken.where(2 * F.col("__t.words") >= F.col("size")).withColumn("__position", F.col("__t.position"))
    return by_position(taken, "__position").select("__doc.*")
