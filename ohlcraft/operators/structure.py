"""Structure of price moves: merged bars, fractals, strokes, segments, pivots, legs and their signals.

The passes with growing lists run as one kernel for each symbol; what needs a few neighbours only stays in windows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MERGED = "symbol long, i int, start_dt timestamp_ntz, end_dt timestamp_ntz, high double, low double"
POINTS = "symbol long, kind string, i int, dt timestamp_ntz, mark string, price double, start_dt timestamp_ntz, end_dt timestamp_ntz"
PIVOTS = (
    "symbol long, i int, start_dt timestamp_ntz, end_dt timestamp_ntz, zd double, zg double, d double, dd double, g double, gg double, "
    "points int, third string, third_dt timestamp_ntz, third_price double"
)
GAP = 0.002


def merge_bars(high: np.ndarray, low: np.ndarray) -> list[list]:
    """Bars [first, last, high, low] without inclusion: a bar inside its neighbour, or around it, is merged with it, to the
    higher values in a rise and the lower ones in a fall."""
    out: list[list] = []
    for i, (h, x) in enumerate(zip(high.tolist(), low.tolist())):
        if out:
            last = out[-1]
            inside = (h <= last[2] and x >= last[3]) or (h >= last[2] and x <= last[3])
            if inside:
                up = len(out) < 2 or last[2] > out[-2][2]
                last[1] = i
                last[2], last[3] = (max(last[2], h), max(last[3], x)) if up else (min(last[2], h), min(last[3], x))
                continue
        out.append([i, i, h, x])
    return out


def fractals(bars: Sequence[Sequence]) -> list[tuple[int, str, float]]:
    """(merged bar, 'g' top or 'd' bottom, price)."""
    out = []
    for k in range(1, len(bars) - 1):
        a, b, c = bars[k - 1], bars[k], bars[k + 1]
        if b[2] > a[2] and b[2] > c[2]:
            out.append((k, "g", b[2]))
        elif b[3] < a[3] and b[3] < c[3]:
            out.append((k, "d", b[3]))
    return out


def _better(mark: str, price: float, than: float) -> bool:
    return price > than if mark == "g" else price < than


def strokes(bars: Sequence[Sequence], marks: Sequence[tuple[int, str, float]], new: bool = True, least: int = 1) -> list[tuple[int, str, float]]:
    """Alternating fractals: of neighbours with one mark the more extreme stays; an opposite one counts when its range does
    not include the other's and at least `least` bars stand between them (raw bars if new, else merged ones)."""
    out: list[tuple[int, str, float]] = []
    for k, mark, price in marks:
        if not out:
            out.append((k, mark, price))
            continue
        j, before, held = out[-1]
        if mark == before:
            if _better(mark, price, held):
                out[-1] = (k, mark, price)
            continue
        # both fractals span a merged bar on either side
        if new:
            between = bars[k - 1][0] - bars[j + 1][1] - 1
        else:
            between = (k - 1) - (j + 1) - 1
        high, low = max(b[2] for b in bars[j - 1 : j + 2]), min(b[3] for b in bars[j - 1 : j + 2])
        top, bottom = max(b[2] for b in bars[k - 1 : k + 2]), min(b[3] for b in bars[k - 1 : k + 2])
        included = (top <= high and bottom >= low) or (top >= high and bottom <= low)
        right = price > held if mark == "g" else price < held
        if between >= least and not included and right:
            out.append((k, mark, price))
    return out


def segments(points: Sequence[tuple[int, str, float]], least: int = 4) -> list[tuple[int, str, float]]:
    """Strokes' ends that are local extremes among those of their mark and at least `least` strokes apart."""
    found = []
    for mark in "gd":
        own = [p for p in points if p[1] == mark]
        for a, b, c in zip(own, own[1:], own[2:]):
            if not _better(mark, a[2], b[2]) and not _better(mark, c[2], b[2]):
                found.append(b)
    place = {p: i for i, p in enumerate(points)}
    out: list[tuple[int, str, float]] = []
    for p in sorted(found, key=lambda p: place[p]):
        if out and out[-1][1] == p[1]:
            if _better(p[1], p[2], out[-1][2]):
                out[-1] = p
        elif not out or place[p] - place[out[-1]] >= least - 1:
            out.append(p)
    return out


def pivots(points: Sequence[tuple[int, str, float]]) -> list[dict]:
    """Ranges that three moves in a row share: zg the least of the first tops, zd the greatest of the first bottoms. A point
    whose move leaves the range and the one after which doesn't come back into it close the pivot as third buy or sell."""
    out: list[dict] = []
    i = 0
    while i + 3 < len(points):
        four = points[i : i + 4]
        zg = min(p[2] for p in four if p[1] == "g")
        zd = max(p[2] for p in four if p[1] == "d")
        if zg <= zd:
            i += 1
            continue
        inside, third, k = list(four), None, i + 4
        while k < len(points):
            p = points[k]
            if p[1] == "d" and p[2] > zg:
                third = ("buy", p)
            elif p[1] == "g" and p[2] < zd:
                third = ("sell", p)
            if third:
                break
            inside.append(p)
            k += 1
        tops, bottoms = [p[2] for p in inside if p[1] == "g"], [p[2] for p in inside if p[1] == "d"]
        out.append({"zd": zd, "zg": zg, "d": max(bottoms), "dd": min(bottoms), "g": min(tops), "gg": max(tops), "points": inside, "third": third})
        i = k - 1 if third else len(points)
    return out


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values("dt", kind="stable", ignore_index=True)


def merged(bars: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        m = merge_bars(pdf["high"].to_numpy(), pdf["low"].to_numpy())
        dt = pdf["dt"].to_numpy()
        rows = [(pdf["symbol"][0], k, dt[a], dt[b], h, x) for k, (a, b, h, x) in enumerate(m)]
        return pd.DataFrame(rows, columns=["symbol", "i", "start_dt", "end_dt", "high", "low"])

    return bars.select("symbol", "dt", "high", "low").groupBy("symbol").applyInPandas(run, MERGED)


def marked_fractals(merged_bars: DataFrame) -> DataFrame:
    """Fractals of merged bars as a three-bar window; gap marks a fractal whose neighbours leave a gap of GAP."""
    w = Window.partitionBy("symbol").orderBy("i")
    h, low = F.col("high"), F.col("low")
    ph, nh, pl, nl = F.lag("high").over(w), F.lead("high").over(w), F.lag("low").over(w), F.lead("low").over(w)
    mark = F.when((h > ph) & (h > nh), "g").when((low < pl) & (low < nl), "d")
    gap = (low > ph * (1 + GAP)) | (h < pl * (1 - GAP))
    out = merged_bars.withColumns({"mark": mark, "gap": gap, "__s": F.lag("start_dt").over(w), "__e": F.lead("end_dt").over(w)}).where("mark is not null")
    return out.select("symbol", "i", "mark", F.when(F.col("mark") == "g", h).otherwise(low).alias("price"), F.col("__s").alias("start_dt"), F.col("__e").alias("end_dt"), "gap")


def points(bars: DataFrame, new: bool = True) -> DataFrame:
    """Fractals, strokes and segments of each symbol in one pass: kind fx, bi, xd."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = _ordered(pdf)
        m = merge_bars(pdf["high"].to_numpy(), pdf["low"].to_numpy())
        dt = pdf["dt"].to_numpy()
        fx = fractals(m)
        bi = strokes(m, fx, new)
        rows = []
        for kind, found in (("fx", fx), ("bi", bi), ("xd", segments(bi))):
            for k, (i, mark, price) in enumerate(found):
                rows.append((pdf["symbol"][0], kind, k, dt[m[i][1]], mark, price, dt[m[i - 1][0]], dt[m[i + 1][1]]))
        return pd.DataFrame(rows, columns=[x.split()[0] for x in POINTS.split(", ")])

    return bars.select("symbol", "dt", "high", "low").groupBy("symbol").applyInPandas(run, POINTS)


def pivot_table(stroke_points: DataFrame) -> DataFrame:
    """Pivots of strokes (kind bi) of points()."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i", ignore_index=True)
        dt = pdf["dt"].to_numpy()
        rows = []
        for k, p in enumerate(pivots(list(zip(range(len(pdf)), pdf["mark"], pdf["price"])))):
            side, at = p["third"] if p["third"] else (None, None)
            rows.append(
                (pdf["symbol"][0], k, dt[p["points"][0][0]], dt[p["points"][-1][0]], p["zd"], p["zg"], p["d"], p["dd"], p["g"], p["gg"],
                 len(p["points"]), side, dt[at[0]] if at else None, at[2] if at else None)
            )
        return pd.DataFrame(rows, columns=[x.split()[0] for x in PIVOTS.split(", ")])

    own = stroke_points.where("kind = 'bi'").select("symbol", "i", "dt", "mark", "price")
    return own.groupBy("symbol").applyInPandas(run, PIVOTS)


def sums_between(marks: DataFrame, bars: DataFrame, value: str) -> DataFrame:
    """marks(symbol, t1, t2 of bars) -> sum of value and number of bars strictly between, from running sums."""
    w = Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    run = bars.select("symbol", "dt", F.sum(value).over(w).alias("s"), F.count("*").over(w).alias("k"), F.col(value).alias("v"))
    a = run.select("symbol", F.col("dt").alias("t1"), F.col("s").alias("s1"), F.col("k").alias("k1"))
    b = run.select("symbol", F.col("dt").alias("t2"), (F.col("s") - F.col("v")).alias("s2"), F.col("k").alias("k2"))
    out = marks.join(a, ["symbol", "t1"]).join(b, ["symbol", "t2"]).withColumn("n", F.col("k2") - F.col("k1") - 1)
    return out.where("n > 0").select("symbol", "t1", "t2", (F.col("s2") - F.col("s1")).alias(value), "n")


def legs(stroke_points: DataFrame, bars_macd: DataFrame) -> DataFrame:
    """Legs between the strokes' ends: direction, price and volume power, sum of |macd|. bars_macd(symbol, dt, volume, macd)."""
    w = Window.partitionBy("symbol").orderBy("i")
    own = stroke_points.where("kind = 'bi'")
    nxt = {f"end_{c}": F.lead(c).over(w) for c in ("dt", "price", "mark")}
    leg = own.withColumns(nxt).where("end_dt is not null").select("symbol", "i", F.col("dt").alias("t1"), F.col("price").alias("p1"), F.col("end_dt").alias("t2"), F.col("end_price").alias("p2"))
    run = Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    sums = bars_macd.select("symbol", "dt", F.sum("volume").over(run).alias("v"), F.sum(F.abs("macd")).over(run).alias("m"), F.col("volume").alias("v0"), F.abs("macd").alias("m0"))
    a = sums.select("symbol", F.col("dt").alias("t1"), (F.col("v") - F.col("v0")).alias("v1"), (F.col("m") - F.col("m0")).alias("m1"))
    b = sums.select("symbol", F.col("dt").alias("t2"), F.col("v").alias("v2"), F.col("m").alias("m2"))
    j = leg.join(a, ["symbol", "t1"]).join(b, ["symbol", "t2"])
    return j.select(
        "symbol", "i", "t1", "t2", F.when(F.col("p2") > F.col("p1"), "up").otherwise("down").alias("direction"),
        F.greatest("p1", "p2").alias("high"), F.least("p1", "p2").alias("low"), F.abs(F.col("p2") - F.col("p1")).alias("price_power"),
        (F.col("v2") - F.col("v1")).alias("vol_power"), (F.col("m2") - F.col("m1")).alias("macd_power"),
    )


def leg_signals(leg_table: DataFrame) -> DataFrame:
    """Per leg: well of the last five legs, third buy or sell, dynamics against the leg two before, five-leg divergence."""
    w = Window.partitionBy("symbol").orderBy("i")

    def at(c: str, k: int) -> Column:
        return F.lag(c, k).over(w)

    df = leg_table.withColumns({f"__{c}{k}": at(c, k) for c in ("high", "low", "price_power", "vol_power", "macd_power") for k in (1, 2, 3, 4)})
    up = F.col("direction") == "up"
    weaker = (F.col("price_power") < F.col("__price_power2")) | (F.col("macd_power") < F.col("__macd_power2"))
    low3 = F.least("__low4", "__low2", "__low3")
    high3 = F.greatest("__high4", "__high2", "__high3")
    share = (F.greatest("__low3", "__low1") < F.least("__high3", "__high1"))
    down_well = ~up & share & (F.col("low") < low3) & weaker
    up_well = up & share & (F.col("high") > high3) & weaker
    big = F.col("price_power") > F.col("__price_power4")
    well = F.when(up_well & big, "up_big").when(up_well, "up_small").when(down_well & big, "down_big").when(down_well, "down_small").otherwise("other")
    zg, zd = F.least("__high4", "__high3", "__high2"), F.greatest("__low4", "__low3", "__low2")
    third = F.when(~up & (zg > zd) & (F.col("low") > zg), "third_buy").when(up & (zg > zd) & (F.col("high") < zd), "third_sell").otherwise("other")
    dyn = (
        F.when(up & (F.col("high") <= F.col("__high2")), "up_no_new_high")
        .when(up & weaker, "up_new_high_divergent")
        .when(up, "up_new_high_strong")
        .when(F.col("low") >= F.col("__low2"), "down_no_new_low")
        .when(weaker, "down_new_low_divergent")
        .otherwise("down_new_low_strong")
    )
    far = (F.col("price_power") < F.col("__price_power4")) & (F.col("vol_power") < F.col("__vol_power4"))
    five = F.when(up & (F.col("high") > F.greatest("__high2", "__high4")) & far, "up").when(~up & (F.col("low") < F.least("__low2", "__low4")) & far, "down").otherwise("other")
    df = df.withColumns({"well": well, "third": third, "dynamics": dyn, "divergence": five}).where("__low4 is not null")
    return df.drop(*[c for c in df.columns if c.startswith("__")])


SELECTOR: tuple[tuple[str, str], ...] = (
    ("third buy confirmed by a strong leg", "third = 'third_buy' and dynamics like '%strong'"),
    ("third buy", "third = 'third_buy'"),
    ("large well in a fall", "well = 'down_big'"),
    ("small well in a fall", "well = 'down_small'"),
    ("five-leg divergence in a fall", "divergence = 'down'"),
    ("third sell", "third = 'third_sell'"),
    ("large well in a rise", "well = 'up_big'"),
    ("five-leg divergence in a rise", "divergence = 'up'"),
)


def selected(signals: DataFrame) -> DataFrame:
    """First matching rule text for the last leg of each symbol, or other."""
    w = Window.partitionBy("symbol").orderBy(F.col("i").desc())
    last = signals.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    text = F.coalesce(*[F.when(F.expr(p), F.lit(t)) for t, p in SELECTOR], F.lit("other"))
    return last.withColumn("rule", text)


def marked_bars(bars: DataFrame, point_table: DataFrame) -> DataFrame:
    """Bars with the fractal, stroke and segment prices that end on them."""
    wide = point_table.groupBy("symbol", "dt").agg(*[F.max(F.when(F.col("kind") == k, F.col("price"))).alias(k) for k in ("fx", "bi", "xd")])
    return bars.join(wide, ["symbol", "dt"], "left")
