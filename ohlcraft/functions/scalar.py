"""Scalar functions: instrument codes, pasted lists, dates, display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code prefixes of the exchanges.
SH_STOCK = ("600", "601", "603", "605", "688", "689", "900")
SZ_STOCK = ("000", "001", "002", "003", "200", "300", "301")
SH_FUND = ("501", "510", "511", "512", "513", "515", "516", "518", "588")
SZ_FUND = ("150", "159", "160", "161", "162", "163", "164", "165", "166", "167", "168", "169")
SZ_INDEX = ("399",)
QUOTES = ("usdt", "husd", "busd", "btc", "eth")
INDEX_PRICE = 2000.0


def _starts(c: Column, prefixes: tuple[str, ...]) -> Column:
    return F.substring(c, 1, 3).isin(*prefixes)


def bare_code(code: Column) -> Column:
    """Six digits of a code with any exchange prefix or suffix; other codes in lower case."""
    digits = F.regexp_extract(code, r"([0-9]{6})", 1)
    return F.when(digits != "", digits).otherwise(F.lower(F.trim(code)))


def normalize_code(code: Column, price: Column | None = None) -> Column:
    """Code with its exchange: sz/sh prefixes and XSHG/XSHE marks first, then the prefix table; 000xxx with a price above
    INDEX_PRICE is a Shanghai index."""
    c, low = bare_code(code), F.lower(code)
    index = F.lit(False) if price is None else (F.substring(c, 1, 3) == "000") & (price > INDEX_PRICE)
    market = (
        F.when(~c.rlike(r"^[0-9]{6}$"), F.lit(None))
        .when(low.startswith("sh") | low.contains("xshg"), "XSHG")
        .when(low.startswith("sz") | low.contains("xshe"), "XSHE")
        .when(F.coalesce(index, F.lit(False)), "XSHG")
        .when(_starts(c, SZ_INDEX + SZ_FUND + SZ_STOCK), "XSHE")
        .when(_starts(c, SH_STOCK + SH_FUND), "XSHG")
        .otherwise("XSHG")
    )
    return F.when(market.isNull(), c).otherwise(F.concat(c, F.lit("."), market))


def classify_code(code: Column) -> Column:
    """struct<known boolean, kind string, exchange string>."""
    c, low = bare_code(code), F.lower(F.trim(code))
    digits = c.rlike(r"^[0-9]{6}$")
    quote = F.lit(False)
    for q in QUOTES:
        quote = quote | low.endswith(q)

    def of(known: bool, kind: str, exchange: str) -> Column:
        return F.struct(F.lit(known).alias("known"), F.lit(kind).alias("kind"), F.lit(exchange).alias("exchange"))

    return (
        F.when(digits & _starts(c, SZ_INDEX), of(True, "index", "XSHE"))
        .when(digits & _starts(c, SZ_FUND), of(True, "fund", "XSHE"))
        .when(digits & _starts(c, SH_FUND), of(True, "fund", "XSHG"))
        .when(digits & _starts(c, SH_STOCK), of(True, "stock", "XSHG"))
        .when(digits & _starts(c, SZ_STOCK), of(True, "stock", "XSHE"))
        .when(~digits & low.rlike(r"^[a-z0-9]+$") & quote, of(True, "crypto", "crypto"))
        .when(~digits & low.rlike(r"^[a-z]{1,2}[0-9]{3,4}$"), of(True, "future", "future"))
        .otherwise(of(False, "unknown", "unknown"))
    )


def split_codes(text: Column) -> Column:
    """Distinct entries of a pasted list: split at line ends, slashes, blanks and commas of either script, quotes trimmed."""
    parts = F.split(F.regexp_replace(text, "[\"'`]", ""), "[\\n\\r/\\s、，,]+")
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def session_end(minute_of_day: Column, step: int) -> Column:
    """End of the bar of step minutes that a minute of the day falls in, as minute of the day: the next multiple of step
    inside (09:30, 11:30] and (13:00, 15:00]; 11:30 and 15:00 end their own bar. Null where no session follows that day."""
    return F.element_at(F.array(*[F.lit(x) for x in session_table(step)]), (minute_of_day + 1).cast("int"))


def session_table(step: int) -> list[int | None]:
    """For each minute of the day the end of its bar."""
    inside = [m for m in range(1440) if m % step == 0 and (570 < m <= 690 or 780 < m <= 900)]
    out: list[int | None] = []
    for m in range(1440):
        out.append(m if m in (690, 900) else next((x for x in inside if x > m), None))
    return out


def display(price: Column, change: Column) -> Column:
    """Price and change in percent."""
    return F.format_string("%.2f/%.2f%%", price, change * 100)


def line_cross(y1: Column, slope1: Column, y2: Column, slope2: Column) -> Column:
    """Where two lines meet; null for parallels."""
    return (y2 - y1) / F.nullif(slope1 - slope2, F.lit(0.0))
