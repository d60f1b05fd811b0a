"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def near_ledger(value: Column, known: Column) -> Column:
    """Equal within a millionth of the known number (of 1 at least)."""
    return F.abs(value - known) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(known))


def near_metric(a: Column, b: Column) -> Column:
    """Equal within a millionth of the larger (of 1 at least)."""
    return F.abs(a - b) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def found_in(value: Column, numbers: Column) -> Column:
    return F.exists(F.coalesce(numbers, F.array().cast("array<double>")), lambda n: near_ledger(value, n))


def closest(value: Column, numbers: Column) -> Column:
    return F.array_min(F.transform(numbers, lambda n: F.struct(F.abs(n - value).alias("gap"), n.alias("n"))))["n"]


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are for a million tokens; null without a price."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 6)


def format_value(v: Column) -> Column:
    """Up to 15 decimals, no trailing zeros, no exponent."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.15f", v.cast("double")), r"0+$", ""), r"\.$", "")
    return F.when(text.isin("", "-0"), "0").otherwise(text)


def exclusive_quantile(values: Column, q: float) -> Column:
    """Quantile of an array by the exclusive method, (n + 1) * q; the value itself for one, null for none."""
    s = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(s)
    pos = (n + 1) * F.lit(float(q))
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor(pos).cast("int")))
    a, b = F.get(s, j - 1), F.get(s, j)
    return F.when(n == 1, F.get(s, F.lit(0))).when(n > 1, a + (b - a) * (pos - j))


def box_gap(a: Column, b: Column) -> Column:
    """Distance of boxes [x0, y0, x1, y1]: the larger of the horizontal and vertical gaps, 0 if they touch."""
    dx = F.greatest(F.lit(0.0), F.get(b, F.lit(0)) - F.get(a, F.lit(2)), F.get(a, F.lit(0)) - F.get(b, F.lit(2)))
    dy = F.greatest(F.lit(0.0), F.get(b, F.lit(1)) - F.get(a, F.lit(3)), F.get(a, F.lit(1)) - F.get(b, F.lit(3)))
    return F.greatest(dx, dy)


def box_overlap(a: Column, b: Column) -> Column:
    """Area that boxes share."""
    w = F.least(F.get(a, F.lit(2)), F.get(b, F.lit(2))) - F.greatest(F.get(a, F.lit(0)), F.get(b, F.lit(0)))
    h = F.least(F.get(a, F.lit(3)), F.get(b, F.lit(3))) - F.greatest(F.get(a, F.lit(1)), F.get(b, F.lit(1)))
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_area(a: Column) -> Column:
    return (F.get(a, F.lit(2)) - F.get(a, F.lit(0))) * (F.get(a, F.lit(3)) - F.get(a, F.lit(1)))


def center_in(a: Column, b: Column) -> Column:
    """Whether the middle of a lies in b."""
    x, y = (F.get(a, F.lit(0)) + F.get(a, F.lit(2))) / 2, (F.get(a, F.lit(1)) + F.get(a, F.lit(3))) / 2
    return x.between(F.get(b, F.lit(0)), F.get(b, F.lit(2))) & y.between(F.get(b, F.lit(1)), F.get(b, F.lit(3)))


def to_pixels(box: Column, dpi: float, matrix: Column | None = None) -> Column:
    """A box in points as pixels; matrix [a, b, c, d, e, f] turns a rotated page's points first."""
    if matrix is not None:
        m = [F.get(matrix, F.lit(i)) for i in range(6)]
        xs, ys = [F.get(box, F.lit(i)) for i in (0, 2)], [F.get(box, F.lit(i)) for i in (1, 3)]
        px, py = [x * m[0] + y * m[2] + m[4] for x, y in zip(xs, ys)], [x * m[1] + y * m[3] + m[5] for x, y in zip(xs, ys)]
        box = F.array(F.least(*px), F.least(*py), F.greatest(*px), F.greatest(*py))
    return F.transform(box, lambda v: v * (dpi / 72.0))
