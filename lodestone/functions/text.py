"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of an id, of a list of ids in brackets, of a number in prose and in a chart's cell, and phrases of refusal.
ID = r"[\w-]+(?::[\w-]+)+"
BRACKETED_IDS = rf"\s*[(\[]\s*(?:ids?:\s*)?{ID}(?:\s*[,;]\s*{ID})*\s*[)\]]"
NUMBER = r"(?<![\w.])-?\d[\d,]*(?:\.\d+)?(?:\s*%)?"
CELL_NUMBER = r"(?:-?\d[\d,]*\.?\d*|-?\.\d+)(?:[eE][+-]?\d+)?"
REFUSAL = r"(?i)not (?:be )?(?:found|mention|stat|provid|includ|specif|say|cover|contain|give)|no information|could ?n[o']t find|does not (?:say|state|mention|provide)|do not (?:say|state|mention|provide|contain)"


def collapse(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_key(c: Column) -> Column:
    """Key under which lines that differ in numbers, case or spacing are the same."""
    return F.regexp_replace(F.lower(collapse(c)), r"\d+", "#")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))


def numbers_in(c: Column) -> Column:
    """Distinct numbers written in a text, ascending; a percentage also as its fraction."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(NUMBER), F.lit(0))

    def values(x: Column) -> Column:
        v = F.regexp_replace(x, r"[,%\s]", "").cast("double")
        return F.when(x.endswith("%"), F.array(v, F.round(v / 100, 10))).otherwise(F.array(v))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(found, values))))


def chart_cell(c: Column) -> Column:
    """First number of a cell, exponent included; over 100 where a percent sign follows within two characters."""
    n = F.regexp_extract(c, rf"({CELL_NUMBER})", 1)
    percent = F.contains(F.regexp_extract(c, rf"{CELL_NUMBER}(.{{0,2}})", 1), F.lit("%"))
    v = F.when(n != "", F.regexp_replace(n, ",", "").cast("double"))
    return F.when(percent, v / 100).otherwise(v)


def strip_ids(c: Column) -> Column:
    """Takes ids in brackets out of prose, then spaces before punctuation."""
    gone = F.regexp_replace(c, BRACKETED_IDS, "")
    return F.regexp_replace(gone, r" +([.,;:])", "$1")


def is_refusal(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(REFUSAL)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def ordinal(n: Column) -> Column:
    last, teens = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100)).between(10, 20)
    end = F.when(teens, "th").when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def dms(degrees: Column) -> Column:
    minutes = F.bround(degrees * 60).cast("int")
    return F.format_string("%d°%02d'", F.floor(minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: s != "")


def excerpt(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def first_line_after(c: Column, head: str) -> Column:
    """The rest of the first line that starts with head; null if none does."""
    found = F.regexp_extract(c, rf"(?m)^{head}: (.*)$", 1)
    return F.when(found != "", found)
