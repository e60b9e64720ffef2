"""Personal data by bootstrapped contextual extraction, in DataFrame expressions only.

Seeds are the e-mail addresses, IP addresses, payment cards and phone numbers that fixed patterns find. The two words
before a seed are its lexical pattern; the same patterns stand before other runs of tokens that carry digits (however
many; a candidate without any digit is not looked for). Patterns and instances form a bipartite graph that is scored in rounds: a pattern by the mean score of its instances (one pseudo
instance of score 0 added), an unlabelled instance by 1 - prod(1 - score) over its patterns. From MIN_SCORE an instance
counts as a seed in the next round, so that it brings further patterns. A run after a pattern of MIN_SEEDS distinct seeds
or more and of score MIN_SCORE or more is reported as an unseen identifier.

Positions come from the text between matches: `split` and `regexp_extract_all` with the same pattern give gaps and
matches, and a running sum over the matches of a text gives code-point offsets. Patterns are written so that Java's
matcher neither recurses nor rescans a run of characters, whatever its length.

Defined results: null or empty text has no spans; rows are told apart by a row number, so null, repeated or tied
doc_ids are judged each by its own text; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, stage, text_of, utf8_of

#: Kind -> pattern. A run is entered at its start, or where the match before ended inside it; the rest is possessive.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: A whole token with a digit.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
#: Cheap tests that a text can hold a match.
GUARDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9]",
    "token": r"[0-9]",
}
MIN_SEEDS = 5
MIN_SCORE = 0.8
ROUNDS = 3
CONTEXT = "context"


def _hits(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<kind, gap, m, before, glued, i>>: matches with the length of the text since the match before, the last
    two words before and whether only blanks stand since the match before."""
    pieces, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def row(piece: Column, m: Column, i: Column) -> Column:
        # the words before may reach over the two matches before, each of which has a word; read from the end, so that only
        # the words themselves are looked at, however long they are
        parts = [F.coalesce(F.get(x, i - k), F.lit("")) for k in (2, 1) for x in (pieces, found)]
        back = F.reverse(F.concat(*parts, piece))
        words = F.reverse(F.regexp_extract(back, r"^[\x20\x09-\x0D]*+([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)", 1))
        return F.struct(F.lit(kind).alias("kind"), F.length(piece).alias("gap"), m.alias("m"), F.lower(words).alias("before"),
                        piece.rlike(r"^[\x20\x09]+$").alias("glued"), i.alias("i"))

    kept = F.transform(found, lambda m, i: row(F.get(pieces, i), m, i))
    empty = F.array().cast("array<struct<kind:string,gap:int,m:string,before:string,glued:boolean,i:int>>")
    return F.when(text.rlike(GUARDS[kind]), kept).otherwise(empty)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def _luhn(digits: Column) -> Column:
    """Luhn checksum of a digit string."""
    each = F.transform(
        F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid() -> Column:
    d = _digits(F.col("m"))
    n = F.length(d)
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    return (
        F.when(F.col("kind") == "email", True)
        .when(F.col("kind") == "ip", F.col("m").rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"))
        .when(F.col("kind") == "card", F.when(n.between(12, 19), _luhn(d)).otherwise(False))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .otherwise(True)
    )


def matches(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text) -> rows(rid, doc_id) of all documents and spans(rid, kind, m, before, start, stop) of valid matches."""
    t = F.col("__text")
    df = docs.select("doc_id", text_of().alias("__text"))
    parts = [_hits(t, k, p) for k, p in PATTERNS.items()] + [_hits(t, "token", TOKEN)]
    raw = df.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.concat(*parts).alias("hits"))
    raw = stage(raw, folder, "hits")
    flat = raw.select("rid", F.inline("hits"))
    run = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.length("m")).over(run)
    placed = flat.withColumn("stop", stop).withColumn("start", F.col("stop") - F.length("m"))
    spans = placed.where(_valid()).select("rid", "kind", "m", "before", "start", "stop", "glued", "i")
    # a token that meets a seed's span is that seed
    order = Window.partitionBy("rid").orderBy("start", "stop", "kind")
    seed = F.col("kind") != "token"
    spans = spans.withColumn("__to", F.max(F.when(seed, F.col("stop"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.withColumn("__next", F.min(F.when(seed, F.col("start"))).over(order.rowsBetween(0, Window.unboundedFollowing)))
    free = (F.coalesce(F.col("__to"), F.lit(0)) <= F.col("start")) & (F.col("__next").isNull() | (F.col("__next") >= F.col("stop")))
    spans = spans.where(seed | free).drop("__to", "__next")
    # tokens with blanks only between them are one candidate
    tokens = Window.partitionBy("rid").orderBy("i")
    fresh = ~(F.col("glued") & (F.coalesce(F.lag("i").over(tokens), F.lit(-2)) == F.col("i") - 1))
    runs = spans.where(~seed).withColumn("__fresh", fresh.cast("int"))
    runs = runs.withColumn("__run", F.sum("__fresh").over(tokens.rowsBetween(Window.unboundedPreceding, 0))).groupBy("rid", "__run").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]), " ").alias("m"),
        F.min_by("before", "i").alias("before"), F.min("start").alias("start"), F.max("stop").alias("stop"),
    )
    columns = ("rid", "kind", "m", "before", "start", "stop")
    spans = spans.where(seed).select(*columns).unionByName(runs.withColumn("kind", F.lit("token")).select(*columns))
    return raw.select("rid", "doc_id"), stage(spans, folder, "spans")


def patterns(spans: DataFrame, folder: str) -> DataFrame:
    """(before): lexical patterns that pass MIN_SEEDS and MIN_SCORE after the last round."""
    edges = (
        spans.where("before <> ''")
        .groupBy("before", F.lower("m").alias("x"))
        .agg(F.max(F.when(F.col("kind") == "token", 0).otherwise(1)).alias("seed"))
    )
    edges = stage(edges.withColumn("s", F.col("seed").cast("double")), folder, "edges")
    for k in range(ROUNDS):
        # instances accepted in the round before count as seeds do
        known = F.sum((F.col("s") >= MIN_SCORE).cast("int"))
        scored = edges.groupBy("before").agg((F.sum("s") / (F.count("*") + 1)).alias("p"), known.alias("n"))
        scored = scored.where(F.col("n") >= MIN_SEEDS).drop("n")
        if k == ROUNDS - 1:
            return scored.where(F.col("p") >= MIN_SCORE).select("before")
        # an instance's score: noisy-or over its patterns; p < 1 because of the pseudo instance
        noisy = edges.join(scored, "before").groupBy("x").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("q"))
        score = F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("q", F.lit(0.0)))
        edges = stage(edges.drop("s").join(noisy, "x", "left").withColumn("s", score).drop("q"), folder, f"edges-{k}")
    raise ValueError("ROUNDS must be positive")


def find(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> (rid, doc_id, spans): spans array<struct<start, k, stop, kind>> by start, then kind."""
    folder = folder or shared_folder(docs.sparkSession)
    rows, spans = matches(docs, folder)
    good = patterns(spans, folder)
    unseen = spans.where("kind = 'token'").join(good, "before", "left_semi").withColumn("kind", F.lit(CONTEXT))
    every = spans.where("kind <> 'token'").unionByName(unseen)
    place = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, CONTEXT)]), F.col("kind"))
    one = F.struct(F.col("start"), place.alias("k"), F.col("stop"), F.col("kind"))
    listed = every.groupBy("rid").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    empty = F.array().cast(listed.schema["spans"].dataType)
    return rows.join(listed, "rid", "left").select("rid", "doc_id", F.coalesce("spans", empty).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each kind, base_sha256 and all spans."""
    found = find(docs)
    base = F.filter("spans", lambda s: s["kind"] != CONTEXT)
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in (*KINDS, CONTEXT)]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets, and n_chars counted anew if there is such a column.

    Spans that overlap one already replaced are left out with it. Rows keep their number and columns.
    """
    folder = shared_folder(docs.sparkSession)
    # rows are known by the SHA-256 of their text: equal texts have equal spans, whatever else differs
    key = F.sha2(utf8_of(), 256)
    found = find(docs.select(key.alias("doc_id"), "text"), folder).where(F.size("spans") > 0)
    one = found.groupBy(F.col("doc_id").alias("__pii_of")).agg(F.first("spans").alias("__pii_spans"))
    df = docs.withColumn("__pii_key", key).join(one, F.col("__pii_key") == F.col("__pii_of"), "left")
    text = text_of()
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))

    def cut(acc: Column, s: Column) -> Column:
        piece = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct(s["stop"].cast("long").alias("at"), F.concat(acc["done"], piece, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("done"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    clean = F.aggregate("__pii_spans", start, cut, lambda a: F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    df = df.withColumn("text", F.when(F.col("__pii_spans").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.col("__pii_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return df.select(*docs.columns)
