"""Secret scans with multipart credential linking.

One pass over each text finds what is a secret by itself (assigned secrets, access keys, long hex runs) and weak candidates that
are one only in company: identifiers (client_id = x, user: y), bare values of mixed letters and digits, endpoints (URLs, host = z).
A text's paragraphs are laid out in scopes, windows of 2 * reach characters that start every reach characters, so that two parts
of a paragraph at most reach apart share one; only scopes that hold a part are written. Spark joins parts to scopes by interval
(equal row and bin of reach characters, then containment) and adds up, per scope, which roles are there. A weak candidate is reported where its
complement is: an identifier with a secret, a value with an identifier, an endpoint with both. Parts are never paired with each other, and a scope is at most
2 * reach characters long, so one text of any length is many small groups.

An endpoint with user and password in it is its own complement. Strong spans count in a scope as what they are: an access key as an
identifier, the others as secrets. A weak candidate that overlaps a strong span, or one of an earlier kind in the order
endpoint, identifier, value, is part of that and no candidate.

Defined results: null and empty texts have no spans; rows are answered each for themselves, also when doc_id is null or repeats (rows of one doc_id
and text share their answer); very long texts are searched whole, in time linear in their length; of spans that start together the kind
named first comes first; an empty table gives no rows; columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ship

ASCII_FOLD = re.I | re.A
#: Kinds of spans in the order in which those that start together are listed; the first three are the base.
KINDS = ["assign", "access", "hex", "endpoint", "identifier", "value"]
BASE = 3
#: Roles as bits: what a span of each kind is in a scope, and what a weak one needs there.
IDENTIFIER, SECRET = 1, 2
ROLES = {"assign": SECRET, "access": IDENTIFIER, "hex": SECRET, "endpoint": 0, "identifier": IDENTIFIER, "value": SECRET}
NEEDS = {"endpoint": IDENTIFIER | SECRET, "identifier": SECRET, "value": IDENTIFIER}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ASCII_FOLD)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # of a run that begins with AKIA, all of it or nothing
HEX = re.compile(r"[0-9a-f]{24,}")
ENDPOINT = re.compile(
    r"""\b(?:https?|ftp|sftp|ssh|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x20\x09-\x0D"'<>]+|\b(?:host|hostname|endpoint|server|base_?url|bucket)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:/_-]{2,}""", ASCII_FOLD
)
IDENT = re.compile(r"""\b(?:access_?key(?:_?id)?|client_?id|account(?:_?id)?|user_?name|user|login|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", ASCII_FOLD)
VALUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: In an endpoint, a user and a password before the host.
LOGIN = re.compile(r"://[^/?#@:]*:[^/?#@]+@")
BLANK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, int]  # start, place in KINDS, end


def mixed(s: str) -> bool:
    """Small letters, capitals and digits are all there."""
    return bool(re.search("[a-z]", s) and re.search("[A-Z]", s) and re.search("[0-9]", s))


def base_spans(text: str) -> list[Span]:
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)])


def weak_spans(text: str, base: list[Span]) -> tuple[list[Span], list[Span]]:
    """Weak candidates outside base, and of them the endpoints that are complete in themselves."""
    taken, weak, whole = sorted((s, e) for s, _, e in base), [], []
    for kind, pattern in ((3, ENDPOINT), (4, IDENT), (5, VALUE)):
        new, at = [], 0
        lowest = list(accumulate((e for _, e in taken), max))  # ends so far, taken being by start
        for m in pattern.finditer(text):
            s, e = m.span()
            at = bisect.bisect_left(taken, (e,), at)
            if (at and lowest[at - 1] > s) or (kind == 5 and not mixed(m.group())):
                continue
            new.append((s, kind, e))
            if kind == 3 and LOGIN.search(m.group()):
                whole.append((s, kind, e))
        weak += new
        taken = sorted(taken + [(s, e) for s, _, e in new])
    return sorted(weak), whole


def scopes_of(text: str, starts: list[int], reach: int) -> list[tuple[int, int]]:
    """Windows (from, to) of 2 * reach characters, reach apart from a paragraph's beginning on, that hold one of the starts."""
    begins = [0, *(m.end() for m in BLANK.finditer(text))]
    out = set()
    for s in starts:
        first = begins[bisect.bisect_right(begins, s) - 1]
        last = begins[bisect.bisect_right(begins, s)] if bisect.bisect_right(begins, s) < len(begins) else len(text)
        k = (s - first) // reach
        out.update((first + j * reach, min(last, first + (j + 2) * reach)) for j in (k - 1, k) if j >= 0)
    return sorted(out)


SPAN = "struct<start:long,kind:int,end:long>"
FOUND = f"doc_id {{}}, text_key long, n_assign long, n_access long, n_hex long, base array<{SPAN}>, weak array<{SPAN}>, whole array<{SPAN}>, scopes array<struct<low:long,high:long>>"
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
SCOPE_ARROW = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))


def _scanner(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, lists = ([], [], []), ([], [], [], [])
            for text in batch.column(2):  # one text at a time as a string
                text = text.as_py() or ""
                base = base_spans(text)
                weak, whole = weak_spans(text, base)
                scopes = scopes_of(text, [s for s, _, _ in [*base, *weak]], reach) if weak else []
                for k, c in enumerate(counts):
                    c.append(sum(1 for b in base if b[1] == k))
                for out, spans in zip(lists, (base, weak, whole)):
                    out.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                lists[3].append([{"low": a, "high": b} for a, b in scopes])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in counts], *[pa.array(x, t) for x, t in zip(lists, (SPAN_ARROW, SPAN_ARROW, SPAN_ARROW, SCOPE_ARROW))]],
                ["doc_id", "text_key", "n_assign", "n_access", "n_hex", "base", "weak", "whole", "scopes"],
            )

    return run


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rows of points (keys, at) with each of intervals (keys, low, high) of the same keys that has low <= at < high.

    Intervals stand once in every bin of width that they touch and points in their own, so an equality of keys and bin brings them together.
    """
    bins = F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}"))
    spread = intervals.where("low < high").select(*keys, "low", "high", F.explode(bins).alias("bin"))
    return points.withColumn("bin", F.expr(f"at div {width}")).join(spread.hint("merge"), [*keys, "bin"]).where("low <= at AND at < high").drop("bin")


def linked_parts(found: DataFrame, reach: int) -> DataFrame:
    """(row, spans): weak spans of rows (row, base, weak, scopes) whose complement stands in one of their scopes."""
    one = found.where("size(weak) > 0").dropDuplicates(["row"])
    parts = one.select("row", F.explode(F.concat("base", "weak")).alias("p")).select("row", F.col("p.start").alias("at"), "p")
    scopes = one.select("row", F.explode("scopes").alias("s")).select("row", "s.low", "s.high")

    def of_kind(values: dict[str, int]) -> Column:
        return F.get(F.array(*[F.lit(values.get(k, 0)) for k in KINDS]), F.col("p.kind"))

    placed = interval_join(parts, scopes, ["row"], reach).withColumn("roles", F.bit_or(of_kind(ROLES)).over(Window.partitionBy("row", "low", "high")))
    needs = of_kind(NEEDS)
    held = placed.where((F.col("p.kind") >= BASE) & (F.col("roles").bitwiseAND(needs) == needs))
    return held.groupBy("row").agg(F.collect_set("p").alias("more"))  # spans of one text


def listed(spans: Column) -> Column:
    """kind:start:end of spans in their order, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secret_scan(docs: DataFrame, reach: int = 500) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (array of spans), spans (array, with what linking adds) of each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = materialize(rows.mapInArrow(_scanner(reach), FOUND.format(kind)))
    row = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text_key").alias("row")
    more = linked_parts(found.select(row, "base", "weak", "scopes"), reach)
    keyed = found.select("doc_id", "n_assign", "n_access", "n_hex", "base", "whole", "weak", row)
    none = F.array().cast(f"array<{SPAN}>")
    alone = keyed.where("size(weak) = 0").withColumn("more", none)
    linked = keyed.where("size(weak) > 0").join(more.hint("merge"), "row", "left").select(*[c for c in alone.columns])
    out = alone.unionByName(linked)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.array_union(F.concat("base", "whole"), F.coalesce("more", none))).alias("spans"))
