"""SQL that checks the structure queries: merged bars to selector, as one chain of common tables."""

from __future__ import annotations

from .oracle import BARS, W
from .q_indicators import MACD, chan_signals

ORACLES: dict[str, str] = {}

#: Merged bars: one row for each bar with the merged bar it ends in, then the last row of each.
_MERGED = """, ms AS (SELECT symbol, rn, 0 AS i, dt AS start_dt, rn AS first, dt AS end_dt, high, low, NULL::DOUBLE AS before FROM b WHERE rn = 1 UNION ALL
 SELECT symbol, rn, CASE WHEN ins THEN i ELSE i + 1 END, CASE WHEN ins THEN start_dt ELSE dt END, CASE WHEN ins THEN first ELSE rn END, dt,
   CASE WHEN NOT ins THEN h ELSE CASE WHEN up THEN greatest(high, h) ELSE least(high, h) END END,
   CASE WHEN NOT ins THEN l ELSE CASE WHEN up THEN greatest(low, l) ELSE least(low, l) END END, CASE WHEN ins THEN before ELSE high END
 FROM (SELECT b.symbol, b.rn, b.dt, b.high AS h, b.low AS l, m.i, m.start_dt, m.first, m.high, m.low, m.before, m.before IS NULL OR m.high > m.before AS up,
         (b.high <= m.high AND b.low >= m.low) OR (b.high >= m.high AND b.low <= m.low) AS ins FROM ms m JOIN b ON b.symbol = m.symbol AND b.rn = m.rn + 1)),
mb AS (SELECT * FROM ms QUALIFY row_number() OVER (PARTITION BY symbol, i ORDER BY rn DESC) = 1),
mn AS (SELECT *, lag(high) OVER s AS ph, lag(low) OVER s AS pl, lead(high) OVER s AS nh, lead(low) OVER s AS nl, lag(start_dt) OVER s AS fs, lead(end_dt) OVER s AS fe, lag(first) OVER s AS ffirst, lead(rn) OVER s AS flast
       FROM mb WINDOW s AS (PARTITION BY symbol ORDER BY i)),
fx AS (SELECT *, CASE WHEN mark = 'g' THEN high ELSE low END AS price, greatest(high, ph, nh) AS top, least(low, pl, nl) AS bottom, row_number() OVER (PARTITION BY symbol ORDER BY i) AS k
       FROM (SELECT *, CASE WHEN high > ph AND high > nh THEN 'g' WHEN low < pl AND low < nl THEN 'd' END AS mark FROM mn) WHERE mark IS NOT NULL)"""

_STROKES = """, bs AS (SELECT symbol, k, 0 AS n, i, mark, price, top, bottom, flast, k AS src FROM fx WHERE k = 1 UNION ALL
 SELECT f.symbol, f.k, CASE WHEN add THEN s.n + 1 ELSE s.n END, CASE WHEN take THEN f.i ELSE s.i END, CASE WHEN take THEN f.mark ELSE s.mark END, CASE WHEN take THEN f.price ELSE s.price END,
   CASE WHEN take THEN f.top ELSE s.top END, CASE WHEN take THEN f.bottom ELSE s.bottom END, CASE WHEN take THEN f.flast ELSE s.flast END, CASE WHEN take THEN f.k ELSE s.src END
 FROM bs s JOIN fx f ON f.symbol = s.symbol AND f.k = s.k + 1,
 LATERAL (SELECT f.mark <> s.mark AND f.ffirst - s.flast - 1 >= 1 AND NOT ((f.top <= s.top AND f.bottom >= s.bottom) OR (f.top >= s.top AND f.bottom <= s.bottom))
            AND (CASE WHEN f.mark = 'g' THEN f.price > s.price ELSE f.price < s.price END) AS add,
          f.mark = s.mark AND (CASE WHEN f.mark = 'g' THEN f.price > s.price ELSE f.price < s.price END) AS better) x, LATERAL (SELECT add OR better AS take) y),
bi AS (SELECT f.*, s.n FROM (SELECT symbol, n, src FROM bs QUALIFY row_number() OVER (PARTITION BY symbol, n ORDER BY k DESC) = 1) s JOIN fx f ON f.symbol = s.symbol AND f.k = s.src),
ext AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n) AS e FROM (
   SELECT *, lag(price) OVER (PARTITION BY symbol, mark ORDER BY n) AS a, lead(price) OVER (PARTITION BY symbol, mark ORDER BY n) AS c FROM bi)
   WHERE a IS NOT NULL AND c IS NOT NULL AND CASE WHEN mark = 'g' THEN a <= price AND c <= price ELSE a >= price AND c >= price END),
xs AS (SELECT symbol, e, 0 AS g, n, mark, price FROM ext WHERE e = 1 UNION ALL
 SELECT f.symbol, f.e, CASE WHEN f.mark <> s.mark AND f.n - s.n >= 3 THEN s.g + 1 ELSE s.g END, CASE WHEN take THEN f.n ELSE s.n END, CASE WHEN take THEN f.mark ELSE s.mark END, CASE WHEN take THEN f.price ELSE s.price END
 FROM xs s JOIN ext f ON f.symbol = s.symbol AND f.e = s.e + 1,
 LATERAL (SELECT CASE WHEN f.mark <> s.mark THEN f.n - s.n >= 3 WHEN f.mark = 'g' THEN f.price > s.price ELSE f.price < s.price END AS take) x),
xd AS (SELECT bi.*, s.g FROM (SELECT symbol, g, n FROM xs QUALIFY row_number() OVER (PARTITION BY symbol, g ORDER BY e DESC) = 1) s JOIN bi ON bi.symbol = s.symbol AND bi.n = s.n)"""

_PIVOTS = """, four AS (SELECT *, lead(n, 3) OVER s AS n3, min(CASE WHEN mark = 'g' THEN price END) OVER q AS zg, max(CASE WHEN mark = 'd' THEN price END) OVER q AS zd FROM bi
   WINDOW s AS (PARTITION BY symbol ORDER BY n), q AS (PARTITION BY symbol ORDER BY n ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
nx AS (SELECT f.symbol, f.n, any_value(f.zg) AS zg, any_value(f.zd) AS zd, any_value(f.zg > f.zd) AS ok, min(CASE WHEN (p.mark = 'd' AND p.price > f.zg) OR (p.mark = 'g' AND p.price < f.zd) THEN p.n END) AS k
   FROM four f LEFT JOIN bi p ON p.symbol = f.symbol AND p.n >= f.n + 4 WHERE f.n3 IS NOT NULL GROUP BY f.symbol, f.n),
wk AS (SELECT symbol, n, 0 AS c FROM nx WHERE n = 0 UNION ALL SELECT nx.symbol, nx.n, w.c + CASE WHEN v.ok THEN 1 ELSE 0 END FROM wk w JOIN nx v ON v.symbol = w.symbol AND v.n = w.n
   JOIN nx ON nx.symbol = w.symbol AND nx.n = CASE WHEN NOT v.ok THEN w.n + 1 ELSE v.k - 1 END),
pv AS (SELECT w.symbol, w.c AS i, v.zd, v.zg, v.k, v.n FROM wk w JOIN nx v ON v.symbol = w.symbol AND v.n = w.n WHERE v.ok),
inside AS (SELECT v.symbol, v.i, any_value(v.zd) AS zd, any_value(v.zg) AS zg, arg_min(p.end_dt, p.n) AS start_dt, arg_max(p.end_dt, p.n) AS end_dt, max(CASE WHEN p.mark = 'd' THEN p.price END) AS d,
   min(CASE WHEN p.mark = 'd' THEN p.price END) AS dd, min(CASE WHEN p.mark = 'g' THEN p.price END) AS g, max(CASE WHEN p.mark = 'g' THEN p.price END) AS gg, count(*)::INT AS points, any_value(v.k) AS k
   FROM pv v JOIN bi p ON p.symbol = v.symbol AND p.n >= v.n AND (v.k IS NULL OR p.n < v.k) GROUP BY v.symbol, v.i)"""

_LEGS = f""", sums AS (SELECT symbol, dt, volume AS v0, abs(macd) AS m0, sum(volume) {W} AS v, sum(abs(macd)) {W} AS m FROM m),
lg AS (SELECT *, lead(end_dt) OVER s AS t2, lead(price) OVER s AS p2 FROM bi WINDOW s AS (PARTITION BY symbol ORDER BY n)),
legs AS (SELECT l.symbol, l.n AS i, l.end_dt AS t1, l.t2, CASE WHEN p2 > price THEN 'up' ELSE 'down' END AS direction, greatest(price, p2) AS high, least(price, p2) AS low, abs(p2 - price) AS price_power,
   y.v - (x.v - x.v0) AS vol_power, y.m - (x.m - x.m0) AS macd_power
   FROM lg l JOIN sums x ON x.symbol = l.symbol AND x.dt = l.end_dt JOIN sums y ON y.symbol = l.symbol AND y.dt = l.t2 WHERE l.t2 IS NOT NULL),
lags AS (SELECT *, {", ".join(f"lag({c}, {k}) OVER s AS {a}{k}" for c, a in (("high", "h"), ("low", "l"), ("price_power", "pp"), ("vol_power", "vp"), ("macd_power", "mp")) for k in (1, 2, 3, 4))}
   FROM legs WINDOW s AS (PARTITION BY symbol ORDER BY i)),
flags AS (SELECT *, coalesce(price_power < pp2 OR macd_power < mp2, false) AS weaker, greatest(l3, l1) < least(h3, h1) AS share, least(h4, h3, h2) AS zg, greatest(l4, l3, l2) AS zd FROM lags WHERE l4 IS NOT NULL),
sig AS (SELECT *, CASE WHEN direction = 'up' AND share AND high > greatest(h4, h2, h3) AND weaker THEN CASE WHEN price_power > pp4 THEN 'up_big' ELSE 'up_small' END
     WHEN direction = 'down' AND share AND low < least(l4, l2, l3) AND weaker THEN CASE WHEN price_power > pp4 THEN 'down_big' ELSE 'down_small' END ELSE 'other' END AS well,
   CASE WHEN zg <= zd THEN 'other' WHEN direction = 'down' AND low > zg THEN 'third_buy' WHEN direction = 'up' AND high < zd THEN 'third_sell' ELSE 'other' END AS third,
   CASE WHEN direction = 'up' THEN CASE WHEN high <= h2 THEN 'up_no_new_high' WHEN weaker THEN 'up_new_high_divergent' ELSE 'up_new_high_strong' END
     ELSE CASE WHEN low >= l2 THEN 'down_no_new_low' WHEN weaker THEN 'down_new_low_divergent' ELSE 'down_new_low_strong' END END AS dynamics,
   CASE WHEN NOT (price_power < pp4 AND vol_power < vp4) THEN 'other' WHEN direction = 'up' AND high > greatest(h2, h4) THEN 'up' WHEN direction = 'down' AND low < least(l2, l4) THEN 'down' ELSE 'other' END AS divergence FROM flags)"""


def chain(*parts: str) -> str:
    return f"WITH RECURSIVE {BARS}{''.join(parts)}"


_POINT = "SELECT symbol, '{}' AS kind, {}::INT AS i, end_dt AS dt, mark, price, fs AS start_dt, fe AS end_dt FROM {}"

ORACLES["chan_merged"] = chain(_MERGED) + " SELECT symbol, i, start_dt, end_dt, high, low FROM mb"
ORACLES["chan_fractals"] = chain(_MERGED) + " SELECT symbol, i, mark, price, fs AS start_dt, fe AS end_dt, (low > ph * (1 + 0.002::DOUBLE)) OR (high < pl * (1 - 0.002::DOUBLE)) AS gap FROM fx"
ORACLES["chan_strokes"] = chain(_MERGED, _STROKES) + f" {_POINT.format('bi', 'n', 'bi')} UNION ALL {_POINT.format('xd', 'g', 'xd')}"
ORACLES["chan_pivots"] = (
    chain(_MERGED, _STROKES, _PIVOTS)
    + """ SELECT v.symbol, v.i, v.start_dt, v.end_dt, v.zd, v.zg, v.d, v.dd, v.g, v.gg, v.points, CASE p.mark WHEN 'd' THEN 'buy' WHEN 'g' THEN 'sell' END AS third, p.end_dt AS third_dt, p.price AS third_price
 FROM inside v LEFT JOIN bi p ON p.symbol = v.symbol AND p.n = v.k"""
)
ORACLES["chan_table"] = (
    chain(_MERGED, _STROKES)
    + """, pt AS (SELECT symbol, end_dt AS dt, 'fx' AS kind, price FROM fx UNION ALL SELECT symbol, end_dt, 'bi', price FROM bi UNION ALL SELECT symbol, end_dt, 'xd', price FROM xd),
 wd AS (SELECT symbol, dt, max(CASE WHEN kind = 'fx' THEN price END) AS fx, max(CASE WHEN kind = 'bi' THEN price END) AS bi, max(CASE WHEN kind = 'xd' THEN price END) AS xd FROM pt GROUP BY symbol, dt)
 SELECT b.symbol, b.dt, fx, bi, xd FROM b LEFT JOIN wd ON wd.symbol = b.symbol AND wd.dt = b.dt"""
)
_SIGNALS = chain(MACD, _MERGED, _STROKES, _LEGS)
ORACLES["chan_signal_marks"] = _SIGNALS + " SELECT symbol, i::INT AS i, t1, t2, direction, high, low, well, third, dynamics, divergence FROM sig"
ORACLES["chan_selector"] = (
    _SIGNALS
    + """ SELECT symbol, t2, direction, CASE WHEN third = 'third_buy' AND dynamics LIKE '%strong' THEN 'third buy confirmed by a strong leg' WHEN third = 'third_buy' THEN 'third buy'
 WHEN well = 'down_big' THEN 'large well in a fall' WHEN well = 'down_small' THEN 'small well in a fall' WHEN divergence = 'down' THEN 'five-leg divergence in a fall' WHEN third = 'third_sell' THEN 'third sell'
 WHEN well = 'up_big' THEN 'large well in a rise' WHEN divergence = 'up' THEN 'five-leg divergence in a rise' ELSE 'other' END AS rule
 FROM sig QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1"""
)


def chan_signal_marks(spark, sf_dir):
    """chan_signals without the running sums, which engines round apart."""
    return chan_signals(spark, sf_dir).select("symbol", "i", "t1", "t2", "direction", "high", "low", "well", "third", "dynamics", "divergence")


QUERIES = {"chan_signal_marks": chan_signal_marks}
