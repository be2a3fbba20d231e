"""Numbers and units as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells that state no number, currency marks and the units they name, Western and full-width.
MISSING = ("-", "--", "n/a", "na", "nan", "none", "null")
CURRENCY_UNITS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₩": "KRW"}
CURRENCY_CODES = ("USD", "EUR", "GBP", "JPY", "KRW", "TWD", "NTD", "CNY", "RMB", "HKD")
FULL_WIDTH = "０１２３４５６７８９．，－＋％＄￥（）"
HALF_WIDTH = "0123456789.,-+%$¥()"

DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def half_width(c: Column) -> Column:
    """Full-width digits and signs as their ASCII forms."""
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, where a column is computed at each place of a lambda that names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parse_number(c: Column) -> Column:
    """A text cell as a double, or null: currency, thousands separators, blanks and a percent sign are notation."""
    marks = "[" + "".join(CURRENCY_UNITS) + "]"
    bare = F.regexp_replace(F.trim(half_width(c)), f"(?i){marks}|\\b({'|'.join(CURRENCY_CODES)})\\b|NT(?=[$])", "")
    bare = F.regexp_replace(F.regexp_replace(F.trim(bare), "%+$", ""), "[, ]", "")
    stated = ~F.lower(bare).isin(*MISSING) & bare.rlike(DECIMAL)
    return F.when(stated, bare.try_cast("double"))


def number(df: DataFrame, column: str) -> Column:
    """A column as doubles: typed columns are cast, text columns are parsed cell by cell."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType):
        return F.col(f"`{column}`").cast("double")
    return parse_number(F.col(f"`{column}`").cast("string"))


def text(column: str | Column) -> Column:
    """A cell as trimmed text; null reads as empty."""
    c = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def filled(column: str | Column) -> Column:
    """A cell's trimmed text, or null if it is blank."""
    return F.nullif(text(column), F.lit(""))


def is_integral(x: Column) -> Column:
    return F.abs(x - F.round(x)) < 1e-9


def round_half_up(x: Column, places: int) -> Column:
    """Rounds half away from zero on the decimal text; negative places round to tens, hundreds and so on."""
    return F.round(x, places)


def show_number(x: Column, places: int | None = None) -> Column:
    """A number as text: with thousands separators, and no more places than its size warrants."""
    if places is not None:
        return F.format_number(x, places)
    whole = is_integral(x) & (F.abs(x) < 1e15)
    few = F.regexp_replace(F.regexp_replace(F.format_string("%.4g", x), r"(\.[0-9]*?)0+(?=$|e)", "$1"), r"\.(?=$|e)", "")
    return F.when(whole, F.format_number(x, 0)).when(F.abs(x) >= 1, F.format_number(x, 2)).otherwise(few)


def places_stated(c: Column) -> Column:
    """Decimal places that a figure's text states."""
    return F.length(F.regexp_extract(c, r"\.([0-9]+)", 1))


def agrees(a: Column, b: Column, share: float = 0.01) -> Column:
    """Equality within a share of the larger figure."""
    return F.abs(a - b) <= F.lit(share) * F.greatest(F.abs(a), F.abs(b)) + 1e-9


def agrees_as_stated(stated: Column, stated_text: Column, found: Column) -> Column:
    """Whether a found figure rounds to the stated one at the stated one's precision."""
    return F.abs(stated - found) <= 0.5 * F.pow(F.lit(10.0), -places_stated(stated_text)) + 1e-9 * F.greatest(F.lit(1.0), F.abs(stated))


def currency_unit(values: Column) -> Column:
    """The unit of a column's array of texts if exactly one currency mark occurs in it."""
    marks = F.array_distinct(F.flatten(F.transform(values, lambda v: F.regexp_extract_all(half_width(v), F.lit("([$€£¥₩])"), 1))))
    named = F.create_map(*[F.lit(x) for pair in CURRENCY_UNITS.items() for x in pair])
    return F.when(F.size(marks) == 1, F.element_at(named, F.get(marks, 0))).otherwise("")


def measures_in(c: Column) -> Column:
    """Figures with their units in Latin prose: array of (text, value, unit)."""
    found = F.regexp_extract_all(c, F.lit(r"(?<![\w.])[+-]?[0-9][0-9,]*(?:\.[0-9]+)?(?:\s?(?:%|°C|[A-Za-zµ]{1,6}(?:/[A-Za-z0-9]{1,6})*))?"), 0)

    def of(m: Column) -> Column:
        figure = F.regexp_extract(m, r"^[+-]?[0-9][0-9,]*(?:\.[0-9]+)?", 0)
        value = F.replace(figure, F.lit(","), F.lit("")).try_cast("double")
        unit = F.trim(F.substring(m, F.length(figure) + 1, F.length(m)))
        return F.named_struct(F.lit("text"), figure, F.lit("value"), value, F.lit("unit"), unit)

    return F.filter(F.transform(found, of), lambda m: m["value"].isNotNull())


#: Spellings of units that name the same unit.
UNIT_ALIASES = {
    "percent": "%", "pct": "%", "hrs": "h", "hr": "h", "hour": "h", "hours": "h", "min": "min", "mins": "min", "minute": "min", "minutes": "min",
    "sec": "s", "secs": "s", "second": "s", "seconds": "s", "tonne": "t", "tonnes": "t", "ton": "t", "tons": "t", "kilogram": "kg", "kilograms": "kg",
    "gram": "g", "grams": "g", "km": "km", "kilometre": "km", "kilometres": "km", "metre": "m", "metres": "m", "litre": "l", "litres": "l", "liters": "l",
}


def canonical_unit(c: Column) -> Column:
    """A unit with each part between slashes in its shortest spelling."""
    named = F.create_map(*[F.lit(x) for pair in UNIT_ALIASES.items() for x in pair])
    parts = F.transform(F.split(F.lower(F.trim(c)), "/"), lambda p: F.coalesce(F.try_element_at(named, p), p))
    return F.array_join(parts, "/")


def tolerant_measure(c: Column) -> Column:
    """(value, low, high, is_range, is_approximate, tolerance) of a cell such as `5 ± 0.3`, `10–20`, `~4`, `(3)`.

    Figures with a magnitude suffix (k, m, bn) are refused, not scaled: all fields are null.
    """
    t = F.trim(half_width(c))
    fig = r"([+-]?[0-9][0-9,]*\.?[0-9]*)"

    def num(pattern: str, group: int) -> Column:
        return F.replace(F.regexp_extract(t, pattern, group), F.lit(","), F.lit("")).try_cast("double")

    plus, span, paren = rf"^~?\s*{fig}\s*(?:±|\+/-)\s*{fig}", rf"^{fig}\s*(?:–|—|-|~|to)\s*{fig}\s*[^0-9]*$", r"^\(([0-9][0-9,]*\.?[0-9]*)\)$"
    single = rf"^(?:~|≈|about |approx\.? ?)?\s*{fig}"
    refused = t.rlike(r"(?i)[0-9]\s*(bn|k|m|mn|million|billion|萬|億)\b")
    by_plus, by_span, by_paren = t.rlike(plus), t.rlike(span), t.rlike(paren)
    value = F.when(by_plus, num(plus, 1)).when(by_span, (num(span, 1) + num(span, 2)) / 2).when(by_paren, -num(paren, 1)).otherwise(num(single, 1))
    low = F.when(by_plus, num(plus, 1) - num(plus, 2)).when(by_span, num(span, 1))
    high = F.when(by_plus, num(plus, 1) + num(plus, 2)).when(by_span, num(span, 2))
    fields = {
        "value": value, "low": low, "high": high, "is_range": by_span & ~by_plus,
        "is_approximate": t.rlike("^(~|≈|about |approx)"), "tolerance": F.when(by_plus, num(plus, 2)),
    }
    return F.struct(*[F.when(~refused, v).alias(k) for k, v in fields.items()])


def magnitude_label(c: Column) -> Column:
    """The order key of a label such as `1K+`, `500+`, `3萬`."""
    scale = F.upper(F.regexp_extract(c, r"[0-9][0-9,]*\.?[0-9]*\s*([kKmM萬億]?)", 1))
    by = F.when(scale == "K", 1e3).when(scale == "M", 1e6).when(scale == "萬", 1e4).when(scale == "億", 1e8).otherwise(1.0)
    return F.replace(F.regexp_extract(c, r"[0-9][0-9,]*\.?[0-9]*", 0), F.lit(","), F.lit("")).try_cast("double") * by
