"""Reports as HTML tables and charts as SVG, a string for each report or chart, built by column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that markup reads, and what stands for them; the first must come first.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")]
#: Colours of series, in turn.
COLOURS = ["#4269d0", "#efb118", "#ff725c", "#6cc5b0", "#3ca951", "#a463f2"]


def escaped(c: Column) -> Column:
    """A value as text of markup; null is empty."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ESCAPES, F.coalesce(c.cast("string"), F.lit("")))


def html_tables(rows: DataFrame, by: str, columns: list[str], order: list[str], title: Column | None = None) -> DataFrame:
    """(by, html): for each report the rows as a table with a head, in the order given; what is in a report is gathered, not all reports.

    title: an expression over the report's name, the name itself unless given.
    """
    cells = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in columns], F.lit("</tr>"))
    head = "<tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr>"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, cells.alias("html")))), lambda r: r["html"]), "")
    named = escaped(title if title is not None else F.col(by))
    return rows.groupBy(by).agg(body.alias("body")).select(by, F.concat(F.lit("<table><caption>"), named, F.lit(f"</caption><thead>{head}</thead><tbody>"), "body", F.lit("</tbody></table>")).alias("html"))


def svg_bars(points: DataFrame, width: float = 600.0, height: float = 300.0) -> DataFrame:
    """(chart_id, svg): points (chart_id, series, place, label, value) as bars side by side, by place and series; bars stand on zero.

    Values are scaled to the largest distance from zero; null values are gaps; a chart of zeros has flat bars.
    """
    bars = points.groupBy("chart_id").agg(F.array_sort(F.collect_list(F.struct("place", "series", "label", F.col("value").cast("double").alias("value")))).alias("b"), F.array_sort(F.collect_set("series")).alias("names"))
    most = F.array_max(F.transform("b", lambda x: F.abs(x["value"])))
    lowest = F.array_min(F.transform("b", lambda x: F.least(x["value"], F.lit(0.0))))
    highest = F.array_max(F.transform("b", lambda x: F.greatest(x["value"], F.lit(0.0))))
    sized = bars.withColumn("step", F.lit(width) / F.size("b")).withColumn("span", F.when(most > 0, highest - lowest).otherwise(F.lit(1.0))).withColumn("top", F.when(most > 0, highest).otherwise(F.lit(0.0)))

    def px(c: Column) -> Column:
        return F.round(c, 1).cast("string")

    def bar(x: Column, i: Column) -> Column:
        y = (F.col("top") - F.greatest(x["value"], F.lit(0.0))) / F.col("span") * height
        colour = F.get(F.array(*map(F.lit, COLOURS)), ((F.array_position(F.col("names"), x["series"]) - 1) % len(COLOURS)).cast("int"))
        return F.concat(
            F.lit('<rect x="'), px(i * F.col("step") + F.col("step") * 0.1), F.lit('" y="'), px(y), F.lit('" width="'), px(F.col("step") * 0.8), F.lit('" height="'), px(F.abs(x["value"]) / F.col("span") * height),
            F.lit('" fill="'), colour, F.lit('"><title>'), escaped(x["label"]), F.lit(": "), x["value"].cast("string"), F.lit("</title></rect>"),
        )

    drawn = F.array_join(F.array_compact(F.transform("b", bar)), "")
    return sized.select("chart_id", F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width:g} {height:g}">'), drawn, F.lit("</svg>")).alias("svg"))
