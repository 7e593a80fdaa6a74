"""Scalar cleaning expressions.

All of them return ``Column`` expressions built from Spark built-ins, so they
stay inside whole-stage codegen and compose into a single projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = " "


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _to_number(c: Column, cast: str, on_error: str) -> Column:
    if on_error == "null":
        return c.try_cast(cast)
    if on_error != "raise":
        raise ValueError("on_error must be 'raise' or 'null'")
    return c.cast(cast)


def strip_nbsp(col) -> Column:
    """Remove every U+00A0 (non-breaking space) character."""
    return F.translate(_c(col), NBSP, "")


def cut_suffix(col, n: int) -> Column:
    """Drop the last ``n`` characters (positional unit cut, like ``s[:-n]``)."""
    c = _c(col)
    return c.substr(F.lit(1), F.greatest(F.length(c) - F.lit(n), F.lit(0)))


def coalesce_price(list_price, discount_price) -> Column:
    """The discount price when present, else the list price."""
    return F.coalesce(_c(discount_price), _c(list_price))


def parse_quantity(col, suffix_len: int, *, strip_first: bool = True, cast: str | None = "double",
                   on_error: str = "raise") -> Column:
    """Remove U+00A0, cut a unit suffix by position, trim and cast.

    ``strip_first=False`` cuts the suffix before removing U+00A0 (the trunk
    field's order).  ``cast=None`` keeps the trimmed string (the persons
    field).  NULL stays NULL.
    """
    c = _c(col)
    if strip_first:
        s = cut_suffix(strip_nbsp(c), suffix_len)
    else:
        s = strip_nbsp(cut_suffix(c, suffix_len))
    s = F.trim(s)
    return s if cast is None else _to_number(s, cast, on_error)


def take_token(col, sep: str, i: int = 1) -> Column:
    """The i-th (1-based) piece of a split on a literal separator."""
    return F.split_part(_c(col), F.lit(sep), F.lit(i))


def year_token(col) -> Column:
    """B8 for the registration year: piece before '/', then before ' '."""
    return F.trim(take_token(F.trim(take_token(col, "/", 1)), " ", 1))


def split_power(col, cast: str = "double", on_error: str = "raise") -> tuple[Column, Column]:
    """``'70 kW, 95 LE'`` -> (70, 95)."""
    c = _c(col)
    kw = parse_quantity(take_token(c, ",", 1), 2, cast=cast, on_error=on_error)
    hp = parse_quantity(take_token(c, ",", 2), 2, cast=cast, on_error=on_error)
    return kw, hp


def literal_null_text(col, compat: bool = False) -> Column:
    """NULL stays NULL; ``compat=True`` reproduces the string 'nan'."""
    c = _c(col)
    return F.coalesce(c, F.lit("nan")) if compat else c


def derive_age(year_col, as_of_year: int, on_error: str = "raise") -> Column:
    """``as_of_year - year`` (as_of_year is explicit so runs repeat); a
    year that is no number raises, or gives NULL with ``on_error='null'``."""
    year = _c(year_col).try_cast("int") if on_error == "null" else _c(year_col).cast("int")
    return (F.lit(int(as_of_year)) - year).cast("int")


def recode_by_substring(col, rules: Sequence[tuple[str, str]]) -> Column:
    """Case-insensitive ``contains`` rules where the later rule wins.

    A value matching no rule is kept; NULL stays NULL.  The CASE chain is
    built in reverse rule order so the first true branch is the last rule.
    """
    c = _c(col)
    low = F.lower(c)
    expr = None
    for pattern, target in reversed(list(rules)):
        cond = low.contains(pattern.lower())
        expr = F.when(cond, F.lit(target)) if expr is None else expr.when(cond, F.lit(target))
    return c if expr is None else expr.otherwise(c)


def safe_ratio(num, den) -> Column:
    """``num`` when ``den = 0``, else ``num / den``."""
    n, d = _c(num), _c(den)
    return F.when(d == 0, n.cast("double")).otherwise(F.try_divide(n, d))


# Substring recode rules of the listing categories, in the
# order they are applied (a later matching rule overrides an earlier one).
FUEL_RULES = [
    ("benzin", "Benzin"),
    ("hibrid", "Hibrid_Elektromos"),
    ("elektromos", "Hibrid_Elektromos"),
    ("manuális", "Manuális"),
]
GEARBOX_RULES = [
    ("automata", "Automata"),
    ("tiptronic", "Automata"),
    ("szekvenciális", "Szekvenciális"),
    ("manuális", "Manuális"),
]
AIRCON_RULES = [
    ("digitális", "Digitális"),
    ("automata", "Automata"),
    ("manuális", "Manuális"),
    ("hőszivattyús klíma", "Automata"),
]
