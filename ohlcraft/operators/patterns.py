"""Candle patterns as window expressions: one score column each (100 bull, -100 bear, 0 none) and their sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import window as W


def candles(bars: DataFrame) -> DataFrame:
    """Adds the parts of a candle and the averages that patterns compare with: over the ten bars before, ranges over five."""
    df = bars if "rn" in bars.columns else W.numbered(bars)
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    df = df.withColumns({"_b": F.abs(c - o), "_r": h - low, "_u": h - F.greatest(o, c), "_l": F.least(o, c) - low, "_d": F.when(c >= o, 1).otherwise(-1)})
    ten, five = W.w().rowsBetween(-10, -1), W.w().rowsBetween(-5, -1)
    df = df.withColumns({"_ab": F.avg("_b").over(ten), "_ar": F.avg("_r").over(ten), "_near": 0.2 * F.avg("_r").over(five), "_equal": 0.05 * F.avg("_r").over(five)})
    return df


def _at(c: str, k: int) -> Column:
    return F.col(c) if k == 0 else F.lag(c, k).over(W.w())


class _Bar:
    """Conditions on the bar k rows back."""

    def __init__(self, k: int) -> None:
        self.o, self.h, self.l, self.c = (_at(x, k) for x in ("open", "high", "low", "close"))
        self.body, self.range, self.up, self.down, self.dir = (_at(x, k) for x in ("_b", "_r", "_u", "_l", "_d"))
        ab, ar = _at("_ab", k), _at("_ar", k)
        self.near, self.equal = _at("_near", k), _at("_equal", k)
        self.long, self.short, self.doji = self.body > ab, self.body < ab, self.body <= 0.1 * ar
        self.white, self.black = self.dir == 1, self.dir == -1
        self.no_up, self.no_down = self.up < 0.1 * ar, self.down < 0.1 * ar
        self.long_up, self.long_down = self.up > self.body, self.down > self.body
        self.very_long_up, self.very_long_down = self.up > 2 * self.body, self.down > 2 * self.body
        self.top, self.bottom = F.greatest(self.o, self.c), F.least(self.o, self.c)


def rules() -> dict[str, Column]:
    """Pattern -> score of the current bar."""
    a, b, c, d, e = (_Bar(k) for k in range(5))

    def sign(bull: Column | None = None, bear: Column | None = None) -> Column:
        out = F.when(F.coalesce(bull, F.lit(False)), 100) if bull is not None else None
        if bear is not None:
            bear = F.coalesce(bear, F.lit(False))
            out = F.when(bear, -100) if out is None else out.when(bear, -100)
        return out.otherwise(0)

    inside = (a.top < b.top) & (a.bottom > b.bottom)
    engulf_up = a.white & b.black & (a.c >= b.o) & (a.o <= b.c) & ((a.c > b.o) | (a.o < b.c))
    engulf_dn = a.black & b.white & (a.o >= b.c) & (a.c <= b.o) & ((a.o > b.c) | (a.c < b.o))
    three_up = a.white & b.white & c.white & (a.c > b.c) & (b.c > c.c)
    three_dn = a.black & b.black & c.black & (a.c < b.c) & (b.c < c.c)
    in_body = lambda x, y: (x.o <= y.top + y.near) & (x.o >= y.bottom - y.near)
    closer = lambda x, y: (x.c > y.c) & (x.o > y.bottom - y.near) & (x.o < y.top + y.near)
    lower = lambda x, y: (x.h < y.h) & (x.l < y.l)
    naked = lambda x: x.long & x.no_up & x.no_down
    whites, blacks = b.white & c.white & d.white, b.black & c.black & d.black
    kick_up, kick_dn = naked(b) & naked(a) & b.black & a.white & (a.l > b.h), naked(b) & naked(a) & b.white & a.black & (a.h < b.l)
    small = b.short & c.short & d.short
    b_in_c = (b.top < c.top) & (b.bottom > c.bottom)
    return {
        "doji": sign(a.doji),
        "engulfing": sign(engulf_up, engulf_dn),
        "hammer": sign(a.short & a.long_down & a.no_up & (a.bottom <= b.l + b.near)),
        "hangingman": sign(None, a.short & a.long_down & a.no_up & (a.bottom >= b.h - b.near)),
        "harami": sign(b.long & a.short & inside & b.black, b.long & a.short & inside & b.white),
        "haramicross": sign(b.long & a.doji & inside & b.black, b.long & a.doji & inside & b.white),
        "invertedhammer": sign(a.short & a.long_up & a.no_down & (a.top < b.bottom)),
        "shootingstar": sign(None, a.short & a.long_up & a.no_down & (a.bottom > b.top)),
        "marubozu": sign(a.long & a.no_up & a.no_down & a.white, a.long & a.no_up & a.no_down & a.black),
        "morningstar": sign(c.long & c.black & b.short & (b.top < c.bottom) & a.white & (a.c > c.c + 0.3 * c.body)),
        "eveningstar": sign(None, c.long & c.white & b.short & (b.bottom > c.top) & a.black & (a.c < c.c - 0.3 * c.body)),
        "piercing": sign(b.black & b.long & a.white & a.long & (a.o < b.l) & (a.c < b.o) & (a.c > b.c + 0.5 * b.body)),
        "darkcloudcover": sign(None, b.white & b.long & a.black & (a.o > b.h) & (a.c > b.o) & (a.c < b.c - 0.5 * b.body)),
        "whitesoldiers": sign(three_up & a.no_up & b.no_up & c.no_up & (a.o > b.o) & (b.o > c.o) & in_body(a, b) & in_body(b, c)),
        "blackcrows": sign(None, three_dn & a.no_down & b.no_down & c.no_down & (a.o < b.o) & (a.o > b.c) & (b.o < c.o) & (b.o > c.c)),
        "inside3": sign(c.long & b.short & b_in_c & c.black & a.white & (a.c > c.o), c.long & b.short & b_in_c & c.white & a.black & (a.c < c.o)),
        "outside3": sign(
            b.white & c.black & (b.c > c.o) & (b.o < c.c) & (a.c > b.c), b.black & c.white & (b.o > c.c) & (b.c < c.o) & (a.c < b.c)
        ),
        "spinningtop": sign(a.short & a.long_up & a.long_down & a.white, a.short & a.long_up & a.long_down & a.black),
        "dragonflydoji": sign(a.doji & a.no_up & ~a.no_down),
        "gravestonedoji": sign(a.doji & a.no_down & ~a.no_up),
        # further two-bar and one-bar patterns
        "belthold": sign(a.long & a.white & a.no_down, a.long & a.black & a.no_up),
        "closingmarubozu": sign(a.long & a.white & a.no_up, a.long & a.black & a.no_down),
        "counterattack": sign(b.long & a.long & b.black & a.white & (F.abs(a.c - b.c) <= a.equal), b.long & a.long & b.white & a.black & (F.abs(a.c - b.c) <= a.equal)),
        "dojistar": sign(b.long & a.doji & b.black & (a.top < b.bottom), b.long & a.doji & b.white & (a.bottom > b.top)),
        "highwave": sign(a.short & a.very_long_up & a.very_long_down & a.white, a.short & a.very_long_up & a.very_long_down & a.black),
        "homingpigeon": sign(b.long & b.black & a.short & a.black & inside),
        "inneck": sign(None, b.black & b.long & a.white & (a.o < b.l) & (a.c >= b.c) & (a.c <= b.c + b.equal)),
        "kicking": sign(
            b.black & b.long & b.no_up & b.no_down & a.white & a.long & a.no_up & a.no_down & (a.l > b.h),
            b.white & b.long & b.no_up & b.no_down & a.black & a.long & a.no_up & a.no_down & (a.h < b.l),
        ),
        "longleggeddoji": sign(a.doji & (a.long_up | a.long_down)),
        "longline": sign(a.long & (a.up < 0.5 * a.body) & (a.down < 0.5 * a.body) & a.white, a.long & (a.up < 0.5 * a.body) & (a.down < 0.5 * a.body) & a.black),
        "matchinglow": sign(b.black & a.black & (F.abs(a.c - b.c) <= b.equal)),
        "morningdojistar": sign(c.long & c.black & b.doji & (b.top < c.bottom) & a.white & (a.c > c.c + 0.3 * c.body)),
        "eveningdojistar": sign(None, c.long & c.white & b.doji & (b.bottom > c.top) & a.black & (a.c < c.c - 0.3 * c.body)),
        "onneck": sign(None, b.black & b.long & a.white & (a.o < b.l) & (F.abs(a.c - b.l) <= b.equal)),
        "rickshawman": sign(a.doji & a.long_up & a.long_down & (F.abs((a.h + a.l) / 2 - a.c) <= a.near)),
        "separatinglines": sign(b.black & a.white & a.long & a.no_down & (F.abs(a.o - b.o) <= b.equal), b.white & a.black & a.long & a.no_up & (F.abs(a.o - b.o) <= b.equal)),
        "shortline": sign(a.short & (a.up < 0.5 * a.body) & (a.down < 0.5 * a.body) & a.white, a.short & (a.up < 0.5 * a.body) & (a.down < 0.5 * a.body) & a.black),
        "sticksandwich": sign(c.black & b.white & a.black & (b.l > c.c) & (F.abs(a.c - c.c) <= c.equal)),
        "takuri": sign(a.doji & a.no_up & a.very_long_down),
        "thrusting": sign(None, b.black & b.long & a.white & (a.o < b.l) & (a.c > b.c + b.equal) & (a.c <= b.c + 0.5 * b.body)),
        "tristar": sign(
            a.doji & b.doji & c.doji & (b.top < c.bottom) & (a.bottom > b.bottom), a.doji & b.doji & c.doji & (b.bottom > c.top) & (a.top < b.top)
        ),
        "crows2": sign(None, c.white & c.long & b.black & (b.bottom > c.top) & a.black & (a.o < b.o) & (a.o > b.c) & (a.c > c.o) & (a.c < c.c)),
        "upsidegap2crows": sign(None, c.white & c.long & b.black & b.short & (b.bottom > c.top) & a.black & (a.o > b.o) & (a.c < b.c) & (a.c > c.c)),
        "identical3crows": sign(None, three_dn & a.no_down & b.no_down & c.no_down & (F.abs(a.o - b.c) <= b.equal) & (F.abs(b.o - c.c) <= c.equal)),
        "starsinsouth3": sign(c.black & c.long & c.long_down & b.black & (b.body < c.body) & (b.l > c.l) & a.black & a.short & a.no_up & a.no_down & (a.l > b.l) & (a.h < b.h)),
        "unique3river": sign(c.long & c.black & b.black & (b.c > c.c) & (b.o <= c.o) & (b.l < c.l) & a.short & a.white & (a.o > b.l)),
        "stalledpattern": sign(None, c.white & b.white & a.white & c.long & b.long & b.no_up & (b.c > c.c) & a.short & (a.c > b.c) & (a.o >= b.c - a.body - b.near)),
        "advanceblock": sign(None, three_up & in_body(a, b) & in_body(b, c) & c.long & (b.body < c.body) & (a.body < b.body) & (a.up > 0.5 * a.body)),
        "tasukigap": sign(
            (b.bottom > c.top) & b.white & a.black & (a.o < b.c) & (a.o > b.o) & (a.c < b.o) & (a.c > c.top),
            (b.top < c.bottom) & b.black & a.white & (a.o < b.o) & (a.o > b.c) & (a.c > b.o) & (a.c < c.bottom),
        ),
        "xsidegap3methods": sign(
            c.white & b.white & (b.bottom > c.top) & a.black & (a.o < b.c) & (a.o > b.o) & (a.c > c.o) & (a.c < c.c),
            c.black & b.black & (b.top < c.bottom) & a.white & (a.o > b.c) & (a.o < b.o) & (a.c < c.o) & (a.c > c.c),
        ),
        "gapsidesidewhite": sign(
            (b.bottom > c.top) & (a.bottom > c.top) & b.white & a.white & (F.abs(a.o - b.o) <= b.equal) & (F.abs(a.body - b.body) <= b.near),
            (b.top < c.bottom) & (a.top < c.bottom) & b.white & a.white & (F.abs(a.o - b.o) <= b.equal) & (F.abs(a.body - b.body) <= b.near),
        ),
        # of four and five bars
        "linestrike3": sign(
            whites & closer(c, d) & closer(b, c) & a.black & (a.o > b.c) & (a.c < d.o),
            blacks & (c.c < d.c) & (b.c < c.c) & a.white & (a.o < b.c) & (a.c > d.o),
        ),
        "abandonedbaby": sign(
            c.long & c.black & b.doji & a.white & (b.h < c.l) & (a.l > b.h) & (a.c > c.c + 0.3 * c.body),
            c.long & c.white & b.doji & a.black & (b.l > c.h) & (a.h < b.l) & (a.c < c.c - 0.3 * c.body),
        ),
        "breakaway": sign(
            e.long & e.black & d.black & (d.top < e.bottom) & lower(c, d) & lower(b, c) & b.black & a.white & (a.c > d.o) & (a.c < e.c),
            e.long & e.white & d.white & (d.bottom > e.top) & lower(d, c) & lower(c, b) & b.white & a.black & (a.c < d.o) & (a.c > e.c),
        ),
        "concealbabyswall": sign(
            blacks & a.black & d.no_up & d.no_down & c.no_up & c.no_down & (b.top < c.bottom) & ~b.no_up & (b.h > c.c) & (a.h > b.h) & (a.l < b.l)
        ),
        "hikkakemod": sign(
            (c.h < d.h) & (c.l > d.l) & (b.h < c.h) & (b.l > c.l) & (c.c <= c.l + c.near) & lower(a, b),
            (c.h < d.h) & (c.l > d.l) & (b.h < c.h) & (b.l > c.l) & (c.c >= c.h - c.near) & lower(b, a),
        ),
        "kickingbylength": sign(
            (kick_up | kick_dn) & F.when(a.body > b.body, a.white).otherwise(b.white), (kick_up | kick_dn) & F.when(a.body > b.body, a.black).otherwise(b.black)
        ),
        "ladderbottom": sign(e.black & d.black & c.black & b.black & (e.o > d.o) & (d.o > c.o) & (e.c > d.c) & (d.c > c.c) & ~b.no_up & a.white & (a.o > b.o) & (a.c > b.h)),
        "mathold": sign(
            e.long & e.white & small & d.black & a.white & (d.bottom > e.c) & (c.bottom < e.c) & (b.bottom < e.c) & (c.bottom > e.c - 0.5 * e.body)
            & (b.bottom > e.c - 0.5 * e.body) & (c.top < d.o) & (b.top < c.top) & (a.o > b.c) & (a.c > F.greatest(d.h, c.h, b.h))
        ),
        "risefall3methods": sign(
            e.long & e.white & small & blacks & (F.greatest(d.top, c.top, b.top) < e.h) & (F.least(d.bottom, c.bottom, b.bottom) > e.l) & (c.c < d.c) & (b.c < c.c) & a.long & a.white & (a.o > b.c) & (a.c > e.c),
            e.long & e.black & small & whites & (F.greatest(d.top, c.top, b.top) < e.h) & (F.least(d.bottom, c.bottom, b.bottom) > e.l) & (c.c > d.c) & (b.c > c.c) & a.long & a.black & (a.o < b.c) & (a.c < e.c),
        ),
        "hikkake": sign((b.h < c.h) & (b.l > c.l) & (a.h < b.h) & (a.l < b.l), (b.h < c.h) & (b.l > c.l) & (a.h > b.h) & (a.l > b.l)),
    }


def patterns(bars: DataFrame) -> DataFrame:
    """Adds one column for each pattern and `patterns`, their sum."""
    df = candles(bars)
    found = rules()
    df = df.withColumns({f"p_{k}": v for k, v in found.items()})
    df = df.withColumn("patterns", sum((F.col(f"p_{k}") for k in found), F.lit(0)))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def after_patterns(df: DataFrame, bars: int = 5) -> DataFrame:
    """Mean forward return of the rows with a pattern sum of either sign."""
    ahead = F.lead("close", bars).over(Window.partitionBy("symbol").orderBy("dt")) / F.col("close") - 1
    return df.withColumn("ahead", ahead).groupBy(F.signum("patterns").alias("side")).agg(F.avg("ahead").alias("ahead"), F.count("ahead").alias("n"))
