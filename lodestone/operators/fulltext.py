"""Full-text search with cover-density ranks, over plain words and English stems.

Texts are split once into words and positions; words that no query asks for are left out before anything is shuffled. Stems
come by way of the distinct words of all texts: those whose stem a query has form a dictionary, and texts are joined to that.

A chunk matches if its plain words satisfy the query or its stems do. Its rank is the better of the two, each the sum over covers,
the shortest stretches of text that satisfy the query, of 0.1 / (1 + words between its first and last that the query does not
have). Covers are found by windows: at each place where something asked for ends, the latest start of every phrase so far is
known; the least of these is where the stretch begins, and it is a cover if no earlier one begins there.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import search_text as st
from ..functions.stemmer import stem
from ..functions.text import tokens
from ..session import ship, written

WEIGHT = 0.1
PHRASES = "query_id {}, g int, never boolean, phrase array<string>, stemmed boolean, all_of boolean"


def _trimmed(phrase: list) -> list:
    """Without the words at both ends that any word matches."""
    at = [i for i, w in enumerate(phrase) if w is not None]
    return phrase[at[0] : at[-1] + 1] if at else []


def _parser(mode: str):
    """Rows (query_id, question) to their phrases: alternative g, whether it must not occur, words (null for one that any word matches)."""

    def groups(question: str) -> list[st.Group]:
        if mode == "websearch":
            return st.parse(question)
        words = [[w] for w in dict.fromkeys(st.words(question))]
        return [st.Group(words)] if mode == "all" and words else [st.Group([w]) for w in words]

    def run(frames):
        for pdf in frames:
            out = []
            for name, question in zip(pdf["query_id"], pdf["question"]):
                for g, group in enumerate(groups(question or "")):
                    for stemmed in (False, True):
                        of = lambda p: _trimmed([None if w in st.STOP else stem(w) for w in p]) if stemmed else p  # noqa: E731,B023
                        need, never = ([x for x in map(of, ps) if x] for ps in (group.need, group.never))
                        if not need and not group.never:
                            continue
                        out += [(name, g, False, x, stemmed, not need) for x in need] + [(name, g, True, x, stemmed, not need) for x in never]
                        if not need and not never:
                            out.append((name, g, True, None, stemmed, True))
            yield pd.DataFrame(out, columns=["query_id", "g", "never", "phrase", "stemmed", "all_of"])

    return run


def _stems(words: DataFrame) -> DataFrame:
    """(word, term) of rows (word): the stem of each; stop words have none."""

    def run(frames):
        for pdf in frames:
            kept = [w for w in pdf["word"] if w not in st.STOP]
            yield pd.DataFrame({"word": kept, "term": [stem(w) for w in kept]}, dtype=object)

    return words.mapInPandas(run, "word string, term string")


def asked_phrases(queries: DataFrame, mode: str, stems: bool) -> DataFrame:
    kind = queries.schema["query_id"].dataType.simpleString()
    return queries.select("query_id", "question").mapInPandas(_parser(mode), PHRASES.format(kind)).where(F.lit(stems) | ~F.col("stemmed"))


def term_words(chunks: DataFrame, terms: DataFrame, stems: bool) -> DataFrame:
    """(word, stemmed, term): the words of texts that stand for the terms (stemmed, term), themselves or, with stems, by their stem."""
    plain = terms.where("NOT stemmed").select(F.col("term").alias("word"), "stemmed", "term")
    if not stems:
        return plain
    every = chunks.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).distinct()
    return plain.union(_stems(every).join(terms.where("stemmed"), "term").select("word", "stemmed", "term"))


def term_places(chunks: DataFrame, words: DataFrame) -> DataFrame:
    """(chunk_id, pos, stemmed, term): where texts hold the terms that words (word, stemmed, term) stand for."""
    return chunks.select("chunk_id", F.posexplode(tokens(F.col("text"))).alias("pos", "word")).join(words, "word").select("chunk_id", "pos", "stemmed", "term")


def phrase_places(places: DataFrame, phrases: DataFrame) -> DataFrame:
    """(chunk_id, phrase, stemmed, start, stop): where the phrases (phrase, stemmed) stand, first and last word."""
    words = phrases.select("phrase", "stemmed", F.posexplode("phrase").alias("at", "term")).where("term IS NOT NULL")
    need = words.groupBy("phrase", "stemmed").agg(F.count("*").alias("need"))
    lines = places.join(words, ["stemmed", "term"]).groupBy("chunk_id", "phrase", "stemmed", (F.col("pos") - F.col("at")).alias("start")).agg(F.count("*").alias("got"))
    whole = lines.join(need, ["phrase", "stemmed"]).where("got = need")
    return whole.select("chunk_id", "phrase", "stemmed", "start", (F.col("start") + F.size("phrase") - 1).alias("stop"))


ROW = ["query_id", "chunk_id", "stemmed"]
#: Queries with more phrases than this are not broadcast.
MOST_PHRASES = 100_000


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), value worked out once."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def query_plans(asked: DataFrame, standing: DataFrame) -> DataFrame:
    """(word, query_id, anchors, versions): each query beside every word that opens an alternative of it.

    versions, over plain words and over stems: terms, the words that stand for each, and groups, the alternatives, with phrases as
    places in terms (null for any word). anchors: of every alternative, the words of the longest term that it needs.
    """
    stated = asked.where("phrase IS NOT NULL")
    words = standing.groupBy("stemmed", "term").agg(F.array_sort(F.collect_set("word")).alias("words"))
    terms = stated.select("query_id", "stemmed", F.explode("phrase").alias("term")).where("term IS NOT NULL").distinct().join(words, ["stemmed", "term"], "left")
    known = terms.groupBy("query_id", "stemmed").agg(F.array_sort(F.collect_list(F.struct("term", F.coalesce("words", F.array().cast("array<string>")).alias("words")))).alias("terms"))
    listed = lambda never: F.collect_set(F.when(F.col("never") == never, F.col("phrase")))
    groups = stated.groupBy("query_id", "stemmed", "g").agg(listed(F.lit(False)).alias("need"), listed(F.lit(True)).alias("bar")).where("size(need) > 0")
    version = groups.groupBy("query_id", "stemmed").agg(F.collect_list(F.struct("need", "bar")).alias("groups")).join(known, ["query_id", "stemmed"])
    names = F.transform("terms", lambda t: t["term"])
    placed = lambda ps: F.transform(ps, lambda p: F.transform(p, lambda t: F.when(t.isNotNull(), F.array_position(names, t).cast("int") - 1)))
    longest = lambda need: F.array_max(F.transform(F.filter(F.flatten(need), lambda t: t.isNotNull()), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    opens = F.flatten(F.transform("groups", lambda g: F.get("terms", F.array_position(names, longest(g["need"])).cast("int") - 1)["words"]))
    shaped = version.select(
        "query_id", opens.alias("opens"),
        F.struct(F.transform("terms", lambda t: t["words"]).alias("terms"), F.transform("groups", lambda g: F.struct(placed(g["need"]).alias("need"), placed(g["bar"]).alias("bar"))).alias("groups")).alias("version"),
    )
    whole = shaped.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("opens"))).alias("anchors"), F.collect_list("version").alias("versions"))
    return whole.select(F.explode("anchors").alias("word"), "query_id", "anchors", "versions")


def _starts(phrase: Column, at: Column) -> Column:
    """Where a phrase stands, of the places of each term."""
    of = lambda i: F.get(at, F.get(phrase, i))
    more = F.aggregate(F.sequence(F.lit(1), F.size(phrase) - 1), of(F.lit(0)), lambda s, i: F.when(F.get(phrase, i).isNull(), s).otherwise(F.array_intersect(s, F.transform(of(i), lambda x: x - i))))
    return F.when(F.size(phrase) == 1, of(F.lit(0))).otherwise(more)


def _stretches(need: Column, starts: Column) -> Column:
    """(stop, start) wherever all phrases of an alternative have stood and a later start is found."""
    one = F.transform(F.get(starts, F.lit(0)), lambda x: F.struct((x + F.size(F.get(need, F.lit(0))) - 1).alias("stop"), x.alias("start")))
    ends = F.array_sort(F.flatten(F.transform(starts, lambda xs, k: F.transform(xs, lambda x: F.struct((x + F.size(F.get(need, k)) - 1).alias("stop"), x.alias("start"), k.alias("k"))))))
    none = F.array().cast("array<struct<stop:int,start:int>>")

    def step(s: Column, e: Column) -> Column:
        last = F.transform(s["last"], lambda x, k: F.when(k == e["k"], e["start"]).otherwise(x))
        later = F.array_min(last) > F.coalesce(F.get(s["out"], F.size(s["out"]) - 1)["start"], F.lit(-1))
        return F.struct(last.alias("last"), F.when(later, F.concat(s["out"], F.array(F.struct(e["stop"].alias("stop"), F.array_min(last).alias("start"))))).otherwise(s["out"]).alias("out"))

    fold = F.aggregate(ends, F.struct(F.array_repeat(F.lit(-1), F.size(need)).alias("last"), none.alias("out")), step)["out"]
    return F.when(F.size(need) == 1, one).otherwise(fold)


def _rank(version: Column, held: Column) -> Column:
    """The sum over covers of a chunk whose words stand at the places held (word to places); null if it satisfies no alternative."""
    empty = F.array().cast("array<int>")
    places = F.transform(version["terms"], lambda ws: F.when(F.size(ws) == 1, F.coalesce(F.try_element_at(held, F.get(ws, F.lit(0))), empty)).otherwise(F.array_sort(F.flatten(F.transform(ws, lambda w: F.coalesce(F.try_element_at(held, w), empty))))))

    def summed(ends: Column, at: Column) -> Column:
        def over(every: Column) -> Column:
            def step(s: Column, e: Column) -> Column:
                start = -e["back"]
                noise = e["stop"] - start - (F.array_position(every, e["stop"]) - F.array_position(every, start))
                return F.when(start > s["from"], F.struct(start.alias("from"), (s["w"] + F.lit(WEIGHT) / (1 + noise)).alias("w"))).otherwise(s)

            return F.aggregate(F.array_sort(F.transform(ends, lambda e: F.struct(e["stop"].alias("stop"), (-e["start"]).alias("back")))), F.struct(F.lit(-1).alias("from"), F.lit(0.0).alias("w")), step)["w"]

        return F.when(F.size(ends) > 0, _let(F.array_sort(F.array_distinct(F.flatten(at))), over))

    def met(at: Column) -> Column:
        def one(g: Column) -> Column:
            barred = F.exists(g["bar"], lambda p: F.size(_starts(p, at)) > 0)
            stretches = lambda starts: F.when(F.forall(starts, lambda s: F.size(s) > 0), _stretches(g["need"], starts)).otherwise(F.array().cast("array<struct<stop:int,start:int>>"))
            return F.when(barred, F.array().cast("array<struct<stop:int,start:int>>")).otherwise(_let(F.transform(g["need"], lambda p: _starts(p, at)), stretches))

        return _let(F.flatten(F.transform(version["groups"], one)), lambda ends: summed(ends, at))

    return _let(places, met)


def ranked_chunks(chunks: DataFrame, asked: DataFrame, standing: DataFrame) -> DataFrame:
    """(query_id, chunk_id, w): the rank of the better version of each chunk that satisfies an alternative.

    Each chunk becomes one row, where the words that any query has stand in it. It meets a query at the first of the query's anchors
    that it holds, and is ranked in that row: no place of a word is paired with queries, sorted or shuffled again.
    """
    places = chunks.select("chunk_id", F.posexplode(tokens(F.col("text"))).alias("pos", "word")).join(standing.select("word").distinct(), "word", "left_semi")
    at = places.select("chunk_id", "word", "pos").repartition("chunk_id").groupBy("chunk_id", "word").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    rows = at.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("held"))
    plans = written(query_plans(asked, standing))
    plans = F.broadcast(plans) if asked.count() <= MOST_PHRASES else plans
    met = rows.select("chunk_id", "held", F.explode(F.map_keys("held")).alias("word")).join(plans, "word")
    own = met.where(F.get(F.array_intersect("anchors", F.map_keys("held")), F.lit(0)) == F.col("word"))
    return own.select("query_id", "chunk_id", F.array_max(F.transform("versions", lambda v: _rank(v, F.col("held")))).alias("w")).where("w IS NOT NULL")


def search(chunks: DataFrame, queries: DataFrame | str, n: int = 20, mode: str = "websearch", stems: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, rank) of queries (query_id, question), or of one question as query 1, by cover density.

    mode websearch: words, "phrases", OR and -not; all: every word; any: at least one. stems=False looks at plain words alone.
    A chunk that is found only for what it lacks has score 0; an alternative that a chunk fails adds nothing to its rank.
    """
    spark = ship(chunks.sparkSession)
    if isinstance(queries, str):
        queries = spark.createDataFrame([(1, queries)], "query_id int, question string")
    asked = written(asked_phrases(queries, mode, stems))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    terms = asked.select("stemmed", F.explode("phrase").alias("term")).where("term IS NOT NULL").distinct()
    of_query = asked.select("query_id", "stemmed", F.explode("phrase").alias("term")).where("term IS NOT NULL").distinct()
    standing = term_words(chunks, terms, stems)
    if mode == "any":  # each place of a word is a cover
        hits = term_places(chunks, standing).join(of_query, ["stemmed", "term"]).groupBy(*ROW).agg((F.count("*") * F.lit(WEIGHT)).alias("w"))
        ranked = hits.groupBy("query_id", "chunk_id").agg(F.round(F.max("w"), 9).alias("score"))
        return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    standing = written(standing)
    ranked = ranked_chunks(chunks, asked, standing).select("query_id", "chunk_id", F.round("w", 9).alias("score"))
    free = asked.where("all_of")
    if mode == "websearch" and not free.isEmpty():
        never = free.where("phrase IS NOT NULL").select("phrase", "stemmed").distinct()
        stand = phrase_places(term_places(chunks, standing), never).select("chunk_id", "phrase", "stemmed").distinct()
        bad = free.join(stand, ["phrase", "stemmed"]).select("query_id", "g", "stemmed", "chunk_id").distinct()
        ranked = ranked.unionByName(_lacking(chunks, asked, bad)).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _lacking(chunks: DataFrame, asked: DataFrame, bad: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score 0) of alternatives that only exclude: each chunk meets those few queries in place, without those it fails."""
    name = F.struct("query_id", "g", "stemmed")
    free = asked.where("all_of").select(name.alias("f")).distinct()
    every = free.agg(F.collect_list("f").alias("every"))  # one row: the stated queries that only exclude
    failed = bad.join(free.select("f.*"), ["query_id", "g", "stemmed"], "left_semi").groupBy("chunk_id").agg(F.collect_list(name).alias("failed"))
    both = chunks.select("chunk_id").join(failed, "chunk_id", "left").join(F.broadcast(every.where("size(every) > 0")))
    left = F.array_except("every", F.coalesce("failed", F.array().cast(every.schema["every"].dataType)))
    return both.select("chunk_id", F.explode(F.array_distinct(F.transform(left, lambda f: f["query_id"]))).alias("query_id")).select("query_id", "chunk_id", F.lit(0.0).alias("score"))
