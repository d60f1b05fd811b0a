"""Captions, transcripts and chart readings as they come back from models: repair, checks and merges."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A number as figures print it, a line that is only one, and one with its unit inside a line.
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
VALUE_LINE = rf"^[~≈<>]?\s*({NUMBER})\s*(%|[A-Za-z×]{{1,3}})?$"
VALUE_WITH_UNIT = rf"({NUMBER})\s*(%|GB|MB|KB|TB|ms|×|x)(?![A-Za-z])"


def repaired_json(c: Column) -> Column:
    """The object in a model's reply: fences off, curly quotes straight, commas before a closing mark gone; null if it still does not parse."""
    body = F.regexp_extract(F.regexp_replace(c, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    plain = F.regexp_replace(F.translate(body, "“”„‟‘’", "\"\"\"\"''"), r",\s*(?=[}\]])", "")
    return F.when(F.try_parse_json(plain).isNotNull() & (plain != ""), plain)


def printed_values(labels: Column) -> Column:
    """Numbers that a figure prints as values, ascending: a line that is only a number (with % or a short unit), else each number
    directly followed by a unit. A percentage counts as its fraction too."""
    lines = F.transform(F.flatten(F.transform(labels, lambda x: F.split(x, r"\r\n|[\n\r]"))), lambda x: F.trim(x))

    def found(line: Column) -> Column:
        alone = F.array(F.struct(F.regexp_extract(line, VALUE_LINE, 1).alias("n"), F.regexp_extract(line, VALUE_LINE, 2).alias("u")))
        numbers, units = F.regexp_extract_all(line, F.lit(VALUE_WITH_UNIT), F.lit(1)), F.regexp_extract_all(line, F.lit(VALUE_WITH_UNIT), F.lit(2))
        return F.when(line.rlike(VALUE_LINE), alone).otherwise(F.zip_with(numbers, units, lambda n, u: F.struct(n.alias("n"), u.alias("u"))))

    def values(x: Column) -> Column:
        v = F.regexp_replace(x["n"], ",", "").cast("double")
        return F.when(x["u"] == "%", F.array(v, F.round(v / 100, 10))).otherwise(F.array(v))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.flatten(F.transform(lines, found)), values))))


def check_values(points: DataFrame, printed: DataFrame) -> DataFrame:
    """points (element_id, series, label, value, flag) as exact if and only if the figure prints the value (element_id, printed), else estimated;

    a figure that prints no number gives none of its points.
    """
    j = points.join(printed.where(F.size("printed") > 0), "element_id")
    exact = F.exists("printed", lambda p: F.abs(F.col("value") - p) < 1e-6)
    return j.withColumn("flag", F.when(exact, "exact").otherwise("estimated")).select(points.columns)


def import_captions(old: DataFrame, new: DataFrame, figures: DataFrame) -> DataFrame:
    """Captions after an import: a record (element_id, image_hash, status, confidence, ...) counts only for a figure with that hash;

    low confidence needs review, and the newer record of an element wins.
    """
    status = F.when((F.col("confidence") == "low") & (F.col("status") == "ok"), "needs_review").otherwise(F.col("status"))
    good = new.join(figures.select("element_id", F.col("content_hash").alias("image_hash")), ["element_id", "image_hash"], "left_semi").withColumn("status", status)
    return old.join(good, "element_id", "left_anti").unionByName(good)


def import_transcripts(old: DataFrame, new: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transcripts, refused): pages of other documents are refused, a blank page is marked, the newer record of a page wins."""
    known = new.join(documents.select("doc_id"), "doc_id", "left_semi").withColumn("blank", F.trim(F.coalesce("text", F.lit(""))) == "")
    refused = new.join(documents.select("doc_id"), "doc_id", "left_anti")
    kept = old if "blank" in old.columns else old.withColumn("blank", F.trim(F.coalesce("text", F.lit(""))) == "")
    return kept.join(known, ["doc_id", "page"], "left_anti").unionByName(known), refused


def open_jobs(jobs: DataFrame, done: DataFrame, key: str = "element_id") -> DataFrame:
    return jobs.join(done.select(key), key, "left_anti")


def job_report(results: DataFrame) -> DataFrame:
    """One row: jobs, validity_rate, seconds_per_job of results (valid, seconds)."""
    return results.agg(F.count("*").alias("jobs"), F.round(F.avg(F.col("valid").cast("int")), 4).alias("validity_rate"), F.round(F.avg("seconds"), 4).alias("seconds_per_job"))


def chart_kind(c: Column) -> Column:
    """'D-9' and the like in a title, else a named division, else Rasi."""
    n = F.regexp_extract(c, r"(?i)\bD\s*-?\s*(\d{1,2})\b", 1)
    return F.when(n != "", F.concat(F.lit("D-"), n)).when(c.rlike(r"(?i)\bnavams[ah]"), "D-9").when(c.rlike(r"(?i)\bdasams[ah]"), "D-10").otherwise("Rasi")


def split_labels(spellings: dict[str, str], least: float = 0.74):
    """A column function: names in a cell without spaces between them, by the longest known spelling first, near ones by similarity."""
    import difflib

    order = sorted(spellings, key=lambda s: (-len(s), s))

    def one(text: str) -> list[str]:
        rest, out = re.sub(r"[^a-z]", "", re.sub(r"\((?:r|ret)\)", "", (text or "").lower())), []
        while rest:
            hit = next((s for s in order if rest.startswith(s)), None)
            if hit is None:
                near = difflib.get_close_matches(rest, order, 1, least)
                if near:
                    out.append(spellings[near[0]])
                break
            out.append(spellings[hit])
            rest = rest[len(hit) :]
        return out

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(s: pd.Series) -> pd.Series:
        return s.map(one)

    return split


def requests_jsonl(jobs: DataFrame) -> DataFrame:
    """One JSON line a job, as a bundle's job file holds them."""
    return jobs.select(F.to_json(F.struct("*")).alias("value"))


def parse_lines(lines: list[str]) -> tuple[list[dict], list[str]]:
    """Records and 'line n: error' of a small driver-side file."""
    good, bad = [], []
    for n, line in enumerate(lines, 1):
        if line.strip():
            try:
                good.append(json.loads(line))
            except ValueError as e:
                bad.append(f"line {n}: {e}")
    return good, bad


def bundle(jobs: DataFrame, prompt: str, model: str, version: str) -> tuple[DataFrame, dict]:
    """(job lines, run record): one JSON line a job (element_id, content_hash, asset_path, context) with its image's name, and what the run is told."""
    name = F.concat(F.col("element_id"), F.regexp_extract("asset_path", r"(\.\w+)$", 1))
    lines = jobs.select(F.to_json(F.struct("element_id", F.col("content_hash").alias("image_hash"), name.alias("image"), "context")).alias("value"))
    return lines, {"prompt": prompt, "model_id": model, "prompt_version": version}


def figure_references(c: Column) -> Column:
    """Numbers of the figures that a text names, each once, in order."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)\b(?:figure|fig\.)\s*(\d+(?:\.\d+)*)"), F.lit(1))
    return F.array_distinct(found)
