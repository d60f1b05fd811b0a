"""Enrichment: links from figures and tables to the paragraphs that discuss them, label checks, search documents and chunks."""

from __future__ import annotations

import re
import time
import unicodedata
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import cosine
from ..functions.text import collapse
from .folds import streamed

# Phrases by which a paragraph points to a figure or table near it.
VISUAL = r"(?:diagram|figure|chart|table|graph|picture|illustration|image)"
BELOW = rf"(?i)\b(?:{VISUAL}\s+below|(?:shown|illustrated|seen|pictured)\s+below|(?:the\s+)?following\s+{VISUAL}|below\s*:)"
ABOVE = rf"(?i)\b(?:{VISUAL}\s+above|(?:shown|illustrated|seen|pictured)\s+above|(?:the\s+)?(?:previous|preceding)\s+{VISUAL})"


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).lower())


def folded(c: Column) -> Column:
    """Compatibility forms folded, lower case: subscripts compare with plain digits. Only texts that are not ASCII go to Python.

    Marked so that a filter on it is no second call, which has a Python process of its own.
    """
    odd = c.rlike(r"[^\x00-\x7f]")
    return F.when(odd, _folded.asNondeterministic()(F.when(odd, c))).otherwise(F.lower(c))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(folded(c), F.lit(r"[a-z0-9]+"), F.lit(0)))


def exclude_figures(elements: DataFrame, files: list[str]) -> DataFrame:
    """elements (element_id, source_file, type, status, skip_reason) with the figures of the listed files skipped, for the reason their owner gave."""
    out = F.col("source_file").isin(files) & F.col("type").isin("image", "vector_figure", "scanned_page")
    return elements.withColumn("skip_reason", F.when(out, "owner_excluded_figures").otherwise(F.col("skip_reason"))).withColumn("status", F.when(out, "skipped").otherwise(F.col("status")))


def target_texts(figures: DataFrame, tables: DataFrame) -> DataFrame:
    """(element_id, text, labels): what each target is about, for the comparison of meanings, and the labels that its paragraphs may quote.

    figures (element_id, short_caption, description, visible_text, caption, text): the model's captions and the printed one, else
    the figure's own text; labels of at least four characters with a letter or digit, each once. tables (element_id, title,
    summary, columns).
    """
    told = F.concat_ws("\n", "short_caption", "description", F.when(F.col("caption") != "", F.col("caption")))
    about = F.when(told != "", told).otherwise(F.coalesce(F.translate("text", "\n", " "), F.lit("")))
    read = F.transform(F.coalesce("visible_text", F.split(F.coalesce("text", F.lit("")), "\n")), lambda x: F.trim(x))
    labels = F.array_distinct(F.filter(read, lambda x: (F.length(x) >= 4) & F.lower(x).rlike("[a-z0-9]")))
    t = tables.select("element_id", F.concat_ws("\n", *[F.when(F.coalesce(c, F.lit("")) != "", c) for c in (F.col("title"), F.col("summary"), F.array_join("columns", " | "))]).alias("text"), F.filter("columns", lambda c: F.length(c) >= 4).alias("labels"))
    return figures.select("element_id", about.alias("text"), labels.alias("labels")).union(t)


def summary_requests(tables: DataFrame, cache: DataFrame, model: str, most_rows: int = 25) -> DataFrame:
    """(key, title, columns, rows) of tables (title, columns, rows) whose summary the cache (key) lacks, each once: the key is a
    sha256 of the model and all that the table holds, the rows shown are the first `most_rows`."""
    key = F.sha2(F.concat(F.lit(f"{model}\n"), F.to_json(F.struct("title", "columns", "rows"))), 256)
    lines = F.array_join(F.transform(F.slice("rows", 1, most_rows), lambda r: F.array_join(r, " | ", "")), "\n")
    asked = tables.select(key.alias("key"), F.coalesce("title", F.lit("(none)")).alias("title"), F.array_join("columns", " | ").alias("columns"), lines.alias("rows"))
    return asked.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def label_shares(figures: DataFrame, least: float = 0.5) -> DataFrame:
    """(element_id, share, status): of the words a model read off a figure (visible_text), the share its own labels (text) have."""
    seen, own = word_set(F.array_join("visible_text", " ")), word_set(F.col("text"))
    w = figures.where("text IS NOT NULL AND text <> ''").select("element_id", "status", seen.alias("seen"), own.alias("own")).where(F.size("seen") > 0)
    share = F.size(F.array_intersect("seen", "own")) / F.size("seen")
    return w.select("element_id", F.round(share, 3).alias("share"), F.when((share < least) & (F.col("status") == "ok"), "needs_review").otherwise(F.col("status")).alias("status"))


def mentions(c: Column) -> Column:
    """(kind, number) of every 'Figure N', 'Fig. N' and 'Table N' in a text, each once."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)\b((?:figure|fig\.|table)\s*\d+(?:\.\d+)*)"), F.lit(1))
    kind = lambda m: F.when(F.lower(m).startswith("table"), "table").otherwise("figure")
    return F.array_distinct(F.transform(found, lambda m: F.struct(kind(m).alias("kind"), F.regexp_extract(m, r"(\d+(?:\.\d+)*)$", 1).alias("number"))))


def explicit_links(targets: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Links by number: targets (doc_id, target_id, kind, label) and paragraphs (doc_id, element_id, text) naming the same figure or table.

    An equi-join on (document, kind, number); a target's own caption is no discussion of it.
    """
    number = F.regexp_extract("label", r"(?i)^\s*(?:figure|fig\.|table)\s*(\d+(?:\.\d+)*)", 1)
    t = targets.select("doc_id", "target_id", "kind", F.lower(collapse(F.col("label"))).alias("own"), number.alias("number")).where("number <> ''")
    p = paragraphs.select("doc_id", "element_id", F.lower(collapse(F.col("text"))).alias("said"), F.explode(mentions(F.col("text"))).alias("m")).select("doc_id", "element_id", "said", "m.kind", "m.number")
    return t.join(p, ["doc_id", "kind", "number"]).where("own <> said").select("doc_id", "target_id", F.col("element_id").alias("text_element_id"), F.lit("explicit").alias("method"), F.lit(1.0).alias("score")).distinct()


def deictic_links(targets: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Links by 'the figure below' and the like: the nearest target that way on the page. Boxes are [x0, y0, x1, y1]."""
    p = paragraphs.select("doc_id", "page", "element_id", "text", F.col("bbox").alias("p"))
    t = targets.select("doc_id", "page", "target_id", F.col("bbox").alias("t"))
    says_below, says_above = F.col("text").rlike(BELOW), F.col("text").rlike(ABOVE)
    pair = p.where(says_below | says_above).join(t, ["doc_id", "page"])
    below = pair.where(says_below & (F.col("t")[1] >= F.col("p")[3] - 1)).groupBy("doc_id", "element_id").agg(F.min_by("target_id", F.struct(F.col("t")[1], "target_id")).alias("target_id"))
    above = pair.where(~says_below & says_above & (F.col("t")[3] <= F.col("p")[1] + 1)).groupBy("doc_id", "element_id").agg(F.max_by("target_id", F.struct(F.col("t")[3], "target_id")).alias("target_id"))
    return below.union(above).select("doc_id", "target_id", F.col("element_id").alias("text_element_id"), F.lit("deictic").alias("method"), F.lit(1.0).alias("score"))


def related_links(targets: DataFrame, paragraphs: DataFrame, window: float = 150.0, label_weight: float = 0.2, least: float = 0.4, least_words: int = 8) -> DataFrame:
    """The most related of the nearby paragraphs of each target.

    targets (doc_id, page, seq, target_id, bbox, section, vector, labels), paragraphs (doc_id, page, seq, element_id, bbox,
    section, text, vector). Nearby: within the window on the page, directly before or after, or of the section within a page.
    """
    p = paragraphs.where(F.size(F.split(F.trim("text"), r"\s+")) >= least_words)
    t = targets.select("doc_id", F.col("page").alias("tp"), F.col("seq").alias("ts"), "target_id", F.col("bbox").alias("t"), F.col("section").alias("tsec"), F.col("vector").alias("tv"), "labels")
    # one equi-join a rule, so that a long document's targets never meet all of its paragraphs
    on_page = t.join(p, (t["doc_id"] == p["doc_id"]) & (t["tp"] == p["page"])).drop(p["doc_id"])
    gap = F.least(F.abs(F.col("bbox")[1] - F.col("t")[3]), F.abs(F.col("t")[1] - F.col("bbox")[3]))
    near = on_page.where(gap <= window).select("target_id", "element_id")
    w = Window.partitionBy("doc_id").orderBy("seq", F.col("target_id").isNotNull())
    both = p.select("doc_id", "seq", "element_id", F.lit(None).cast(t.schema["target_id"].dataType).alias("target_id")).unionByName(t.select("doc_id", F.col("ts").alias("seq"), F.lit(None).cast(p.schema["element_id"].dataType).alias("element_id"), "target_id"))
    beside = both.select("target_id", F.last("element_id", True).over(w).alias("prev"), F.first("element_id", True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next")).where("target_id IS NOT NULL")
    beside = beside.select("target_id", F.explode(F.array("prev", "next")).alias("element_id")).where("element_id IS NOT NULL")
    titled = p.where(F.size("section") > 0).select(F.col("doc_id").alias("d"), F.col("section").alias("sec"), "page", "element_id")
    section = t.where(F.size("tsec") > 0).join(titled, (t["doc_id"] == titled["d"]) & (t["tsec"] == titled["sec"]) & (F.abs(titled["page"] - t["tp"]) <= 1)).select("target_id", "element_id")
    chosen = near.union(beside).union(section).distinct()
    close = chosen.join(t, "target_id").join(p.drop("doc_id"), "element_id")
    held = F.size(F.filter("labels", lambda x: F.contains(F.lower("text"), F.lower(x))))
    share = F.when(F.size("labels") > 0, held / F.size("labels")).otherwise(0.0)
    scored = close.withColumn("score", F.round(cosine(F.col("tv"), F.col("vector")) + label_weight * share, 3))
    best = scored.groupBy("doc_id", "target_id").agg(F.max_by(F.struct("element_id", "score"), F.struct("score", -F.col("seq"))).alias("b"))
    return best.where(F.col("b.score") >= least).select("doc_id", "target_id", F.col("b.element_id").alias("text_element_id"), F.lit("related").alias("method"), F.col("b.score").alias("score"))


def first_rule(explicit: DataFrame, deictic: DataFrame, related: DataFrame) -> DataFrame:
    """Links of the first rule that gave a target any."""
    d = deictic.join(explicit, "target_id", "left_anti")
    r = related.join(explicit, "target_id", "left_anti").join(deictic, "target_id", "left_anti")
    return explicit.unionByName(d).unionByName(r)


def unlinked(targets: DataFrame, links: DataFrame) -> DataFrame:
    return targets.join(links, "target_id", "left_anti").select("target_id")


def islands(blocks: DataFrame, key: str = "section") -> DataFrame:
    """blocks (doc_id, seq, key) with island: runs of neighbours that share the key, numbered from 1."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    new = ~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)
    return blocks.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w)).drop("new")


def _word_pieces(text: str, limit: int) -> list[tuple[str, int]]:
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    if len(spans) <= limit:
        return [(text, len(spans))]
    cuts = [0, *(spans[i][0] for i in range(limit, len(spans), limit)), len(text)]
    return [(text[a:b], min(limit, len(spans) - k * limit)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]


def chunk_text(blocks: DataFrame, max_tokens: int = 800, overlap: float = 0.15, pieces: Callable[[str, int], list[tuple[str, int]]] = _word_pieces) -> DataFrame:
    """(doc_id, chunk_id, element_ids, text): paragraphs (doc_id, seq, element_id, section, text) gathered per run of a section.

    A chunk takes paragraphs while the budget holds, and begins with whole trailing paragraphs of the one before, up to
    the overlap. pieces(text, limit) gives (part, tokens) and may be any tokenizer. A fold over a document's paragraphs, of which it
    holds one chunk's.
    """
    carry_most = int(max_tokens * overlap)

    rows = blocks.select("doc_id", "seq", "element_id", "section", "text")

    def chunks(block: Iterator[tuple]):
        made = 0

        def chunk(doc, label, parts):
            nonlocal made
            made += 1
            ids = list(dict.fromkeys(p[0] for p in parts))
            return doc, f"{doc}:text:{made}", ids, "\n".join([label, "\n\n".join(p[1] for p in parts)])

        for section, part in groupby(block, key=lambda r: tuple(r[3] or ())):
            label = " > ".join(section) or "(no section)"
            budget = max(1, max_tokens - sum(n for _, n in pieces(label, 1 << 30)) - 1)
            held, used = [], 0
            for doc, _, element, _, text in part:
                for piece, n in pieces(text, budget):
                    if held and used + n > budget:
                        yield chunk(doc, label, held)
                        keep, size = [], 0
                        while held and size + held[-1][2] <= carry_most:
                            keep.insert(0, held.pop())
                            size += keep[0][2]
                        held, used = (keep, size) if size + n <= budget else ([], 0)
                    held.append((element, piece, n))
                    used += n
            if held:
                yield chunk(doc, label, held)

    kind = blocks.schema["doc_id"].dataType.simpleString()
    return streamed(rows, ["doc_id"], ["seq"], chunks, f"doc_id {kind}, chunk_id string, element_ids array<string>, text string")


def figure_documents(figures: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, element_id, text) of figures (doc_id, seq, element_id, short_caption, description, labels, keywords, caption, placements, section, contexts)."""

    def part(head: str, c: Column) -> Column:
        return F.when(c.isNotNull() & (c != ""), F.concat(F.lit(head), c))

    told = F.coalesce("short_caption", "description", part("", F.array_join("labels", " | ")), "caption", "placements").isNotNull()
    text = F.concat_ws(
        "\n", "short_caption", "description", part("Labels: ", F.array_join("labels", " | ")), part("Keywords: ", F.array_join("keywords", ", ")), part("Caption: ", F.col("caption")),
        part("Placements: ", F.col("placements")), part("Section: ", F.array_join("section", " > ")), F.array_join(F.transform("contexts", lambda c: F.concat(F.lit("Context: "), c)), "\n"),
    )
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    numbered = figures.withColumn("n", n).where(told)
    return numbered.select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":figure:"), F.col("n").cast("string")).alias("chunk_id"), "element_id", F.regexp_replace(text, r"\n\z", "").alias("text"))


def table_documents(tables: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, element_id, dense_text, keyword_text) of tables (doc_id, seq, element_id, title, summary, columns, rows, section)."""
    heads = F.concat(F.lit("Columns: "), F.array_join("columns", " | "))
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ", "")), "\n")
    title = F.coalesce("title", F.lit(""))
    dense = F.concat_ws("\n", title, F.coalesce("summary", F.lit("")), heads, F.concat(F.lit("Section: "), F.array_join("section", " > ")))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    trim = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    return tables.withColumn("n", n).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(":table:"), F.col("n").cast("string")).alias("chunk_id"), "element_id", trim(dense).alias("dense_text"), trim(F.concat_ws("\n", title, heads, cells)).alias("keyword_text"))


def embed_missing(texts: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64, prefix: str = "", attempts: int = 3) -> DataFrame:
    """(key, vector) for texts (key, text) that the cache (key, vector) lacks, each key once, by an injected model in batches.

    prefix is what the model wants before a text of this kind (a query, a passage). A batch that fails is asked again, at most
    `attempts` times in all, after one second, then two.
    """
    missing = texts.join(cache, "key", "left_anti").dropDuplicates(["key"]).select("key", "text")

    def run(frames):
        for pdf in frames:
            out = []
            for a in range(0, len(pdf), batch):
                asked = [prefix + t for t in pdf["text"].iloc[a : a + batch]]
                for n in range(attempts):
                    try:
                        out += embed(asked)
                        break
                    except Exception:
                        if n == attempts - 1:
                            raise
                        time.sleep(n + 1)
            yield pd.DataFrame({"key": pdf["key"], "vector": out})

    return missing.mapInPandas(run, f"key {texts.schema['key'].dataType.simpleString()}, vector array<double>")
