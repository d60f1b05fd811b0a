"""Registered queries that SQL cannot express, against plain Python on the smallest tables."""

import hashlib
import math
import re

import numpy as np

from lodestone.operators import astro
from lodestone.plans.registry import QUERIES, Tables
from test_fulltext import query_brute


def run(spark, sf, name):
    return QUERIES[name][0](spark, sf).collect()


def top(scores, n):
    return {k: i + 1 for i, (k, _) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:n])}


def test_hybrid_websearch(spark, sf):
    t = Tables(spark, sf)
    chunks = {r.chunk_id: (r.text, np.array(r.embedding, float)) for r in t.chunks().collect()}
    got = {}
    for r in run(spark, sf, "hybrid_websearch"):
        got.setdefault(r.query_id, {})[r.chunk_id] = (r.rank, r.semantic_rank, r.keyword_rank, r.score)
    for q in t.questions().collect():
        w = re.split(r"\s+", q.question)
        query, v = f'{w[0]} OR "{w[1]} {w[2]}"', np.array(q.vector, float)
        semantic = top({c: round(float(x @ v / (np.linalg.norm(x) * np.linalg.norm(v))), 9) for c, (_, x) in chunks.items()}, 20)
        scores = {c: round(x, 9) for c, (text, _) in chunks.items() if (x := query_brute(text, query)) is not None}
        keyword = top(scores, 20)
        fused = {c: round((1 / (60 + semantic[c]) if c in semantic else 0) + (1 / (60 + keyword[c]) if c in keyword else 0), 9) for c in {*semantic, *keyword}}
        want = {c: (rank, semantic.get(c), keyword.get(c), fused[c]) for c, rank in top(fused, 8).items()}
        assert {c: x[:3] for c, x in got[q.query_id].items()} == {c: x[:3] for c, x in want.items()}
        assert all(math.isclose(got[q.query_id][c][3], want[c][3], abs_tol=1e-9) for c in want)


def test_hybrid_websearch_asks_all_words(spark, sf):
    """Every item is asked to its last word, three a search; all searches of a few items against plain Python."""
    t = Tables(spark, sf)
    chunks = {r.chunk_id: (r.text, np.array(r.embedding, float)) for r in t.chunks().collect()}
    got = {}
    for r in run(spark, sf, "hybrid_websearch"):
        assert (r.item_id, r.word) == (r.query_id % (1 << 32), 3 * (r.query_id >> 32))
        got.setdefault((r.item_id, r.word), {})[r.chunk_id] = (r.rank, r.semantic_rank, r.keyword_rank)
    questions = {q.query_id: (re.split(r"\s+", q.question), np.array(q.vector, float)) for q in t.questions().collect()}
    assert set(got) == {(q, i) for q, (w, _) in questions.items() for i in range(0, len(w), 3)}
    for q, (w, v) in [x for x in questions.items() if x[0] % 13 == 0]:
        semantic = top({c: round(float(x @ v / (np.linalg.norm(x) * np.linalg.norm(v))), 9) for c, (_, x) in chunks.items()}, 20)
        for i in range(0, len(w), 3):
            query = w[i] + (f' OR "{" ".join(w[i + 1 : i + 3])}"' if len(w) > i + 1 else "")
            keyword = top({c: round(x, 9) for c, (text, _) in chunks.items() if (x := query_brute(text, query)) is not None}, 20)
            fused = {c: round((1 / (60 + semantic[c]) if c in semantic else 0) + (1 / (60 + keyword[c]) if c in keyword else 0), 9) for c in {*semantic, *keyword}}
            assert got[q, i] == {c: (rank, semantic.get(c), keyword.get(c)) for c, rank in top(fused, 8).items()}, (q, i)


def test_questions_of_few_words(spark):
    from lodestone.plans.more import asked_by_threes

    rows = [(1, "one"), (2, "one two"), (3, "a b\nc  d"), (4, ""), (5, None), (6, "a b c d e f")]
    asked = asked_by_threes(spark.createDataFrame([(i, q, [1.0]) for i, q in rows], "query_id long, question string, vector array<double>")).collect()
    assert sorted((r.item_id, r.word, r.question) for r in asked) == [
        (1, 0, "one"), (2, 0, 'one OR "two"'), (3, 0, 'a OR "b c"'), (3, 3, "d"), (4, 0, ""), (5, 0, ""), (6, 0, 'a OR "b c"'), (6, 3, 'd OR "e f"'),
    ]
    assert all(r.query_id == r.item_id + (r.word // 3 << 32) for r in asked)


def test_chunk_text(spark, sf):
    got = {}
    for r in run(spark, sf, "chunk_text"):
        got.setdefault(r.doc_id, []).append((int(r.chunk_id.rsplit(":", 1)[1]), r.elements, r.text_md5))
    for d in Tables(spark, sf).documents.collect():
        pieces = []
        budget = 200 - len("(no section)".split()) - 1
        for n, line in enumerate((d.text or "").split("\n")):
            at = [m.start() for m in re.finditer(r"\S+", line)]
            if line and len(at) <= budget:
                pieces.append((n, line, len(at)))
            elif line:
                cuts = [0, *at[budget::budget], len(line)]
                pieces += [(n, line[a:b], len(line[a:b].split())) for a, b in zip(cuts, cuts[1:])]
        chunks, now = [], []
        for p in pieces:
            if now and sum(x[2] for x in now) + p[2] > budget:
                chunks.append(now)
                k = len(now)
                while k and sum(x[2] for x in now[k - 1 :]) <= 30:
                    k -= 1
                now = now[k:] if sum(x[2] for x in now[k:]) + p[2] <= budget else []
            now = [*now, p]
        chunks += [now] if now else []
        want = [(i + 1, len({x[0] for x in c}), hashlib.md5(("(no section)\n" + "\n\n".join(x[1] for x in c)).encode()).hexdigest()) for i, c in enumerate(chunks)]
        assert sorted(got.get(d.doc_id, [])) == want, d.doc_id


def test_chart_yogas(spark, sf):
    kendra, fallen = {1, 4, 7, 10}, {b: (astro.SIGNS.index(s) + 6) % 12 for b, s in astro.EXALTED.items()}
    up = {b: astro.SIGNS.index(s) for b, s in astro.EXALTED.items()}
    charts, got = {}, {}
    for r in Tables(spark, sf).charts().collect():
        charts.setdefault(r.chart_id, {})[r.body] = int(r.longitude // 30) % 12
    for r in run(spark, sf, "chart_yogas"):
        got.setdefault(r.chart_id, set()).add((r.name, r.bodies))
    for chart, s in charts.items():
        count = lambda a, b: (b - a) % 12 + 1
        house = {b: count(s["Lagna"], s[b]) for b in s}
        lord = {h: astro.RULERS[(s["Lagna"] + h - 1) % 12] for h in range(1, 13)}
        strong = lambda b: s[b] == up[b] or (s[b] != fallen[b] and astro.RULERS[s[b]] == b)
        want = set()
        if count(s["Moon"], s["Jupiter"]) in kendra:
            want.add(("Gajakesari", "Jupiter"))
        if s["Sun"] == s["Mercury"]:
            want.add(("Budha-Aditya", "Sun, Mercury"))
        if s["Moon"] == s["Mars"]:
            want.add(("Chandra-Mangala", "Moon, Mars"))
        want |= {(name, b) for b, name in astro.MAHAPURUSHA.items() if strong(b) and house[b] in kendra}
        if not any(count(s["Moon"], s[b]) in (2, 12) for b in astro.PLANETS if b not in ("Sun", "Moon")):
            helpers = [b for b in astro.PLANETS if b != "Moon" and (house[b] in kendra or count(s["Moon"], s[b]) in kendra)]
            want.add(("Kemadruma (cancelled)", ", ".join(helpers)) if helpers else ("Kemadruma", ""))
        for b in astro.PLANETS:
            if any(lord[h] == b for h in (4, 7, 10)) and any(lord[h] == b for h in (5, 9)):
                want.add(("Raja yoga", b))
        for name, ours, theirs in (("Raja yoga", (1, 4, 7, 10), (1, 5, 9)), ("Dhana yoga", (2, 11), (1, 5, 9))):
            want |= {(name, ", ".join(sorted((lord[h], lord[g])))) for h in ours for g in theirs if lord[h] != lord[g] and s[lord[h]] == s[lord[g]]}
        want |= {(name, lord[h]) for h, name in ((6, "Harsha"), (8, "Sarala"), (12, "Vimala")) if house[lord[h]] in (6, 8, 12)}
        for b in fallen:
            if s[b] != fallen[b]:
                continue
            who = {astro.RULERS[up[b]]} | {x for x in (astro.RULERS[s[b]], next((y for y in up if up[y] == s[b]), None)) if x and x != b}
            if any(house[x] in kendra or (x != "Moon" and count(s["Moon"], s[x]) in kendra) for x in who):
                want.add(("Neecha Bhanga", b))
        assert got.get(chart, set()) == want, chart


def test_paired_bootstrap(spark, sf):
    (r,) = run(spark, sf, "paired_bootstrap")
    d = np.array([x.toxic - x.quality for x in Tables(spark, sf).labels.collect() if x.toxic is not None and x.quality is not None], float)
    rng = np.random.default_rng(1)
    means = np.array([rng.choice(d, len(d)).mean() for _ in range(4000)])
    flips = np.array([(d * rng.choice([-1, 1], len(d))).mean() for _ in range(4000)])
    assert math.isclose(r["mean"], d.mean(), abs_tol=1e-12) and r.n == len(d) and r.low < d.mean() < r.high
    spread = means.std()
    assert abs(r.low - np.quantile(means, 0.025)) < spread and abs(r.high - np.quantile(means, 0.975)) < spread
    assert abs(r.p - (np.abs(flips) >= abs(d.mean()) - 1e-12).mean()) < 0.1
