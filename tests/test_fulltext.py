"""Stems and cover-density ranks against what is published of them and against plain walks over the texts."""

import re

import numpy as np
import pytest

from lodestone.functions import search_text as st
from lodestone.functions.stemmer import stem

# Samples of the published vocabulary of the English stemmer.
STEMS = """consign consign|consigned consign|consigning consign|consignment consign|consist consist|consisted consist|consistency consist|consistent consist|consistently consist|consisting consist|consists consist
consolation consol|consolations consol|consolatory consolatori|console consol|consoled consol|consoles consol|consolidate consolid|consolidated consolid|consolidating consolid|consoling consol|consolingly consol|consols consol|consonant conson|consort consort|consorted consort|consorting consort|conspicuous conspicu|conspicuously conspicu|conspiracy conspiraci|conspirator conspir|conspirators conspir|conspire conspir|conspired conspir|conspiring conspir|constable constabl|constables constabl|constance constanc|constancy constanc|constant constant
knack knack|knackeries knackeri|knacks knack|knag knag|knave knave|knaves knave|knavish knavish|kneaded knead|kneading knead|knee knee|kneel kneel|kneeled kneel|kneeling kneel|kneels kneel|knees knee|knell knell|knelt knelt|knew knew|knick knick|knif knif|knife knife|knight knight|knightly knight|knights knight|knit knit|knits knit|knitted knit|knitting knit|knives knive|knob knob|knobs knob|knock knock|knocked knock|knocker knocker|knockers knocker|knocking knock|knocks knock|knopp knopp|knot knot|knots knot
generate generat|generously generous|general general|community communiti|arsenal arsenal|hopping hop|hoping hope|hoped hope|agreed agre|feed feed|ties tie|cries cri|gas gas|this this|gaps gap|kiwis kiwi|luxuriating luxuri|bed bed|shred shred|shed shed|say say|by by|cry cri|youth youth|boyish boyish|relational relat|conditional condit|digitizer digit|vietnamization vietnam|analogously analog|electricity electr|hopefulness hope|goodness good|adoption adopt|controll control|roll roll|cease ceas|rate rate|skies sky|succeeding succeed|innings inning|national nation|rational ration|happily happili|abilities abil"""


def test_stems():
    pairs = [p.split(" ") for p in re.split(r"[|\n]", STEMS)]
    wrong = [(a, b, stem(a)) for a, b in pairs if stem(a) != b]
    assert not wrong


def trimmed(p):
    at = [i for i, w in enumerate(p) if w is not None]
    return p[at[0] : at[-1] + 1] if at else []


def rank_brute(words, groups):
    """Cover density of a list of words (None: a stop word) for groups [(need, never)] of phrases; None if it does not match."""

    def places(p):
        return [(i, i + len(p) - 1) for i in range(len(words) - len(p) + 1) if all(x is None or words[i + j] == x for j, x in enumerate(p))]

    held = [[places(p) for p in need] for need, never in groups if need and all(map(places, need)) and not any(map(places, never))]
    if not held:
        lacking = any(not need and not any(map(places, never)) for need, never in groups)
        return 0.0 if lacking else None
    asked = {x for need, never in groups for p in need + never for x in p if x is not None}
    entries = [i for i, w in enumerate(words) if w in asked]

    def satisfied(a, b):
        return any(all(any(a <= s and e <= b for s, e in ps) for ps in group) for group in held)

    total, begin = 0.0, 0
    while True:  # forward to the first end, back to the last beginning, on from behind that
        stop = next((k for k in range(begin, len(entries)) if satisfied(entries[begin], entries[k])), None)
        if stop is None:
            return total
        start = next(k for k in range(stop, -1, -1) if satisfied(entries[k], entries[stop]))
        total += 0.1 / (1 + entries[stop] - entries[start] - (stop - start))
        begin = start + 1


def query_brute(text, question, mode="websearch", stems=True):
    plain = st.words(text or "")
    if mode == "websearch":
        groups = [(g.need, g.never) for g in st.parse(question)]
    else:
        words = [[w] for w in dict.fromkeys(st.words(question))]
        groups = ([(words, [])] if words else []) if mode == "all" else [([w], []) for w in words]
    out = []
    for of in (lambda w: w, lambda w: None if w in st.STOP else stem(w))[: 1 + stems]:
        mapped = [([trimmed([of(w) for w in p]) for p in need], [trimmed([of(w) for w in p]) for p in never]) for need, never in groups]
        mapped = [([p for p in need if p], [p for p in never if p], bool(g[1])) for (need, never), g in zip(mapped, groups)]
        r = rank_brute([of(w) for w in plain], [(need, never) for need, never, excludes in mapped if need or excludes])
        out += [r] if r is not None else []
    return max(out) if out else None


QUESTIONS = [
    "red fish", '"red fish" blue', "red OR fish", 'red -fish', '-fish', '"the fish of red"', '"fish fish"', "running fish OR blues -red", "the", "", '-the', '"of the" red', "fish " * 3, '"blue fish running" OR "red red"', "unknown OR red", "unknown", '-unknown', "red fish blue the runs",
]


def texts(seed, n=60):
    rng, vocabulary = np.random.default_rng(seed), "red fish blue run runs running the of fishes and x y z".split()
    out = [" ".join(rng.choice(vocabulary, int(rng.integers(0, 40)))) for _ in range(n)]
    return [*out, None, "", "Red, FISH! red-fish", "fish " * 500 + "red"]


@pytest.mark.parametrize("mode", ["websearch", "all", "any"])
def test_cover_density(spark, mode):
    from lodestone.operators import fulltext

    rows = list(enumerate(texts(2)))
    chunks = spark.createDataFrame([(i, t, "x") for i, t in rows], "chunk_id long, text string, word string").repartition(3)
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, question string")
    for stems in (True, False):
        got = {}
        for r in fulltext.search(chunks, asked, 15, mode, stems).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.chunk_id, r.score)
        for k, question in enumerate(QUESTIONS):
            scores = {i: s for i, t in rows if (s := query_brute(t, question, mode, stems)) is not None}
            want = sorted(((round(-s, 9), i) for i, s in scores.items()))[:15]
            assert [got.get(k, {})[n + 1][0] for n in range(len(got.get(k, {})))] == [i for _, i in want], (question, stems)
            assert all(abs(got[k][n + 1][1] + s) < 1e-8 for n, (s, _) in enumerate(want))
    none = asked.where("query_id < 0")
    assert fulltext.search(chunks, none, 5, mode).count() == 0 and fulltext.search(chunks.limit(0), asked, 5, mode).count() == 0


@pytest.mark.parametrize("mode", ["websearch", "all"])
def test_ranks_in_the_row(spark, mode):
    """Chunks are ranked in their row: places are shuffled once, to their chunk, and what is ranked once, to its query."""
    from lodestone.operators import fulltext

    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts(3))], "chunk_id long, text string")
    asked = spark.createDataFrame([(0, 'red OR "fish blue"'), (1, "red fish"), (2, "runs -blue")], "query_id int, question string")
    plan = fulltext.search(chunks, asked, 5, mode)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(query_id") == 1 and plan.count("Exchange hashpartitioning(chunk_id") == 1 and "SortMergeJoin" not in plan


def test_postings_in_the_row(spark):
    """Words are counted in their row, and a chunk's scores are summed where its postings are."""
    from lodestone.operators import retrieval

    chunks = spark.createDataFrame([(1, "red fish, Red x"), (2, None), (3, "y")], "chunk_id long, text string")
    posts = retrieval.postings(chunks, spark.createDataFrame([(1, "red"), (2, "fish"), (3, "red")], "query_id int, term string"))
    assert "Exchange hashpartitioning(chunk_id" not in posts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, posts.select("chunk_id", "length", "term", "tf").collect())) == [(1, 4, "", 1), (1, 4, "fish", 1), (1, 4, "red", 2), (2, 0, "", 1), (3, 1, "", 1)]
    asked = spark.createDataFrame([(1, "red"), (2, "fish red")], "query_id int, question string")
    plan = retrieval.bm25_topn(chunks, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(query_id#" in plan and not [x for x in plan.split("Exchange hashpartitioning(query_id#")[1:] if ", chunk_id#" in x.split(")")[0]]
