"""The ten operators against brute force on small frames and tables, with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lodestone.llm import queries as q
from lodestone.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
SHARED = " ".join(f"s{i}" for i in range(60))
TEXTS = [
    (1, f"alpha beta {SHARED} gamma"), (2, f"other words {SHARED} delta\nline two is here for all"), (3, None), (4, ""), (5, "   \n\t"),
    (6, LONG), (7, f"{SHARED} {SHARED}"), (8, "line two is here for all\nline twx is here for all\nunique ending"), (8, "line two is here for all\nline twx is here for all\nunique ending"),
    (None, f"{SHARED} and more"), (9, "idiot scum"), (10, "Released under the MIT License. Apache  license; GENERAL public-license é"),
]


def docs(spark, rows=TEXTS):
    return spark.createDataFrame(
        [(i, t, "en", None if k == 4 else f"src{k % 3}", len(t or ""), 0.5, 3, "x") for k, (i, t) in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars long, score double, size int, row_key string",
    )


def empty(spark):
    return docs(spark).limit(0)


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def windows_brute(rows, width):
    first, words = {}, [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for s in range(len(w) - width + 1) if i is not None else ():
            g = tuple(w[s : s + width])
            first[g] = min(first.get(g, (i, s)), (i, s))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for s in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[s : s + width])] < (i, s):
                gone |= set(range(s, s + width))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(spark, sf):
    from pyspark.sql import functions as F

    from lodestone.llm.substring_dedup import substring_dedup

    def run(df):
        return sorted(map(tuple, substring_dedup(df, 20).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()), key=repr)

    assert run(docs(spark).repartition(3)) == windows_brute(TEXTS, 20)
    assert run(empty(spark)) == []
    real = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, q.op1_substring_dedup(spark, sf).collect()), key=repr) == windows_brute(real, 20)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def links_brute(rows, threshold):
    ok = [(i, np.array(v, float), k) for i, v, k in rows if v and k is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    pairs = [(a[0], b[0]) for n, a in enumerate(ok) for b in ok[:n] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / math.sqrt((a[1] @ a[1]) * (b[1] @ b[1])) >= threshold]
    n = defaultdict(int)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    of = components([r[0] for r in rows], pairs)
    return sorted((i, n[i], of[i], of[i] == i) for i, *_ in rows)


@pytest.mark.parametrize("cell_rows,block", [(2048, 1024), (40, 16)])
def test_embedding_links(spark, cell_rows, block):
    from lodestone.llm.embedding_dedup import embedding_links

    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    near = np.concatenate([base, base[:30] + 0.05 * rng.standard_normal((30, 16)), base[:1] + 0.03 * rng.standard_normal((50, 16)), base[:3], 2 * base[3:6]])
    rows = [(i, v.tolist(), i % 2 if i < 60 else (i - 60) % 2) for i, v in enumerate(np.float32(near))]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [1.0, None], 1), (903, [float("nan")] * 16, 1), (904, rows[0][1], None), (905, [float("inf")] * 16, 1), (906, [], 0)]
    got = sorted(map(tuple, embedding_links(vectors(spark, rows), 0.93, cell_rows=cell_rows, block=block).collect()))
    want = links_brute(rows, 0.93)
    if cell_rows == 2048:
        assert got == want
    else:  # cells may miss some, by their calibration
        assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want))
    assert embedding_links(vectors(spark, rows).limit(0)).collect() == []


def test_embedding_cells_at_their_default_size(spark):
    """A label past the size at which cells start: pairs planted just above the threshold are found as the calibration promises, and no others."""
    from lodestone.llm.embedding_dedup import embedding_links

    rng = np.random.default_rng(31)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1)[:, None] * x
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = np.where(np.arange(3000) % 10 == 0, 0.929, 0.931)  # a tenth just below
    y = cosine[:, None] * x + np.sqrt(1 - cosine**2)[:, None] * side
    rows = [(i, v.tolist(), 7) for i, v in enumerate([*x, *y])]
    got = {r.vec_id: r.n_links for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.93).collect()}
    assert sum(got.values()) % 2 == 0 and not any(got[i] for i in range(6000) if i % 3000 % 10 == 0)
    assert sum(got[i] == 1 for i in range(3000)) / 2700 >= 0.97


def test_embedding_links_of_repeated_ids(spark):
    """A vec_id under two labels is two vectors: their links and components stay apart."""
    from lodestone.llm.embedding_dedup import embedding_links

    e = [[1.0, 0.0, 0.0], [0.99, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.1]]
    rows = [(1, e[0], 0), (2, e[1], 0), (1, e[2], 1), (3, e[3], 1), (0, e[0], 2), (7, e[0], 0)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_links(vectors(spark, rows)).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (7, 2, 1)]


def test_embedding_recall(spark, sf):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table(spark, sf, "embeddings").collect()]
    want, got = links_brute(rows, 0.93), sorted(map(tuple, q.op2_embedding_dedup(spark, sf).collect()))
    assert sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)


def pieces_brute(rows, size):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        cut = len(ids) if len(ids) <= size else len(ids) % size or size
        for piece, a in enumerate([0, *range(cut, len(ids), size)]):
            part = ids[a : cut if not a else a + size]
            out.append((i, piece, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def check_packing(out, size):
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    return len(by)


def test_packing(spark, sf):
    from lodestone.llm.packing import best_fit_packing

    odd = [(26, "x <|endoftext|> y"), (27, "<|endoftext|><|endoftext|> lead"), (28, "tail  <|endoftext|>"), (29, "<|endoftext|"), (20, "a  b   c　d\n\n x 's don't  "), (21, " lead"), (22, "trail "), (23, "x" * 5000), (24, "é ü 12 a1b2 ... !?"), (25, "q " * 3000)]
    for rows, df, size in [([*TEXTS, *odd], docs(spark, [*TEXTS, *odd]), 2048), ([tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()], table(spark, sf, "documents"), 2048)]:
        out = best_fit_packing(df, q.vocabulary(), size).collect()
        assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out], key=repr) == pieces_brute(rows, size)
        least = -(-sum(r.length for r in out) // size)
        assert check_packing(out, size) <= least * 1.02 + 1
    assert best_fit_packing(empty(spark), q.vocabulary()).collect() == []


def test_packing_cuts_long_texts(spark, monkeypatch):
    from lodestone.llm import packing

    code, text = packing.Coder(q.vocabulary()), "one two  three\nfour é fünf " * 400 + "end"
    want = code.ids(text)
    monkeypatch.setattr(packing, "SEGMENT", 50)
    assert code.ids(text) == want


def triplets(n, size, seed):
    """3 n lengths that fill n sequences exactly, three each: best fit by length misses that by far."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        a = int(rng.integers(size * 38 // 100, size * 49 // 100))
        b = int(rng.integers(size // 4, (size - a) // 2))
        out += [a, b, size - a - b]
    return rng.permutation(out).tolist()


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_injection_beats_best_fit_and_noise(seed):
    from lodestone.llm import packing as m

    lengths, rng = triplets(40, 2048, seed), np.random.default_rng(seed)
    plain = len(m.first_fit(lengths, 2048))
    noisy = min(len(m.group(sorted(range(len(lengths)), key=lambda i: -lengths[i] * z[i]), lengths, [], 2048)) for z in 1 + 0.3 * rng.random((200, len(lengths))))
    bins = m.evolve(lengths, [], 2048, seed)
    assert sorted(i for b in bins for i in b) == list(range(120)) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= 42 < noisy <= plain


def test_islands_beat_best_fit_over_shards(spark):
    from lodestone.llm import packing as m

    lengths = triplets(60, 2048, 5)
    pieces = spark.createDataFrame([(i, 0, 0, n, i, 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long, copy int")
    out = m.pack_pieces(pieces, 2048, shard=90).collect()
    assert sorted((r.doc_id, r.length) for r in out) == list(enumerate(lengths))
    assert check_packing(out, 2048) <= 64 < len(m.first_fit(lengths, 2048))


def test_url_filter(spark):
    from lodestone.llm.url_filter import url_filter

    link = '<head><LINK rel="canonical" href="%s"></head>'
    rows = [
        (1, "http://a.example.org/es/x", None, "example.org/es/", "block"), (2, "https://example.net/copy", link % "http://a.example.org/es/x", None, "block"),
        (3, "http://example.net/copy/#top", "", None, "block"), (4, "https://www.example.com/fr/y", link % "https://example.net/copy", "com/fr/", "allow"),
        (5, "http://EXAMPLE.org/en/1?x", "", "example.org/en/1", "block"), (6, "http://xexample.org/es/", "", "org/", "allow"), (7, None, link % "http://a.example.org/es/x", None, "allow"),
        (8, "no scheme", "", None, "allow"), (9, "http://example.com", "", None, "allow"), (10, "http://other.net/p", '<meta http-equiv="refresh" content="0; url=/q?utm_source=x">', None, "allow"),
        (11, "https://other.net/q", link % "//shop.com/de/1", None, "block"), (10, "http://other.net/p", '<meta http-equiv="refresh" content="0; url=/q">', None, "block"),
    ]
    rows[9] = (*rows[9][:4], "block")
    df = spark.createDataFrame([r[:3] + ("z", "z") for r in rows], "page_id long, url string, html string, host string, node string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in url_filter(df, q.RULES).collect())
    assert got == sorted((r[0], r[3], r[4]) for r in rows)
    assert url_filter(df.limit(0), q.RULES).collect() == []


def test_url_filter_reads_tags_of_any_length(spark):
    from lodestone.llm.url_filter import url_filter

    long, to = "x" * 5000, "http://example.org/es/x"
    rows = [
        (1, "http://one.net/", f'<link data-x="{long}" rel="canonical" href="{to}">'), (2, "http://two.net/", f'<link rel="canonical" href="{to}" data-x="{long}">'),
        (3, "http://three.net/", f'<meta content="0; url={to}" data-x="{long}" http-equiv="refresh">'), (4, "http://four.net/", f'<link rel="icon" href="{to}"><meta name="refresh" content="url={to}"><link rel="canonical" href="/own">'),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter(df, q.RULES).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_url_filter_follows_what_pages_state(spark):
    """Hand-made pages with edges of every kind, against the registered SQL as well."""
    import duckdb

    from lodestone.llm.url_filter import url_filter

    bad = "http://example.org/es/x"
    rows = [
        (1, "http://a.net/1", f'<link rel="canonical" href="{bad}?a=1&amp;b=2">'), (2, f"{bad}?a=1&b=2", ""), (3, "http://b.net/", f'<!-- <link rel="canonical" href="{bad}"> -->'),
        (4, "http://example.org/fr/deep/page", '<link href="../../es/y" rel="alternate canonical">'), (5, "http://c.net/p/q?z=1", '<link rel="canonical" href="?u=2">'), (6, "http://c.net/p/q?u=2", f'<meta http-equiv="Refresh" content="5;URL=\'{bad}\'">'),
        (7, "http://d.net/", '<link rel="canonical" href="#top"><link rel=canonical>'), (8, "http://e.net/a/b/", '<link rel="canonical" href="./../c/./d">'), (9, "http://e.net/a/c/d", f'<link data-rel="canonical" href="{bad}">'), (10, "http://e.net/a/c/d/", f"<link rel='canonical' href='{bad}'>"),
        (11, "http://f.net/", f'<!-- open <link rel="canonical" href="{bad}">'), (12, "http://g.net/", '<link rel="canonical" href="https://h.net/x?next=http://example.org/es/x">'), (13, "http://i.net/", "<link rel=canonical href=&#47;k>"), (14, "http://i.net/k", f'<link rel="CANONICAL" href="{bad}">'),
        (15, "http://j.net/", None), (16, "http://xn.net/..", ""),
    ]
    rows += [(100 + i, f"http://chain.net/{i}", f'<link rel="canonical" href="/{i + 1}">') for i in range(30)] + [(130, "http://chain.net/30", f'<link rel="canonical" href="{bad}">')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter(df, q.RULES).collect()}
    assert {i for i, r in got.items() if r[3] == "block"} == {1, 2, 5, 6, 8, 9, 10, 13, 14, *range(100, 131)}
    assert got[4][2:] == ("org/", "allow")
    con = duckdb.connect()
    pages = df.toPandas()
    con.register("pages", pages)
    want = con.execute(q.ORACLES["op4_url_filter"]).fetchall()
    assert got == {r[0]: tuple(r[1:]) for r in want}


def test_toxicity(spark, sf):
    from lodestone.llm.toxicity import toxicity

    rows = [(i, ("you are an idiot and scum today. fine weather" if i % 3 == 0 else f"calm words number{i} about gardens. fine weather")) for i in range(300)]
    df, labels = docs(spark, [*rows, (None, None), (999, ""), (999, "idiot")]), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    out = toxicity(df, labels).collect()
    assert len(out) == 303 and all(0 <= r.score <= 1 for r in out)
    assert all(r.predicted == int(r.doc_id % 3 == 0) for r in out if r.doc_id is not None and r.doc_id < 300)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert {r.score for r in toxicity(df, labels.limit(0)).collect()} == {0.0} and toxicity(empty(spark), labels).collect() == []


def test_threats_are_learnt(spark):
    """A word that is no insult by itself but stands before a target in toxic texts becomes a threat, and each machine counts."""
    from lodestone.llm import toxicity as m

    rng = np.random.default_rng(12)
    calm = [f"calm{x}" for x in range(60)]
    fill = lambda: " ".join(rng.choice(calm, 6))
    # gut: in all texts, but before a target only in toxic ones
    rows = [(i, f"{fill()} gut you. {fill()}" if i % 4 == 0 else f"{fill()} you, gut {fill()}. {fill()}") for i in range(400)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    lexicon, _ = m.learn(df, labels)
    assert m.THREATENS + "gut" in lexicon and "gut" not in lexicon
    held = [r for r in m.toxicity(df, labels).collect() if r.held_out]
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in held) and len(held) > 60
    silent = {0: {"T": (0, 0.0), "Y": (0, 0.0), "*": (0, 1.0)}}  # no threat reaches a target
    assert not any(r.predicted for r in m.toxicity(df, labels, machines=(m.INSULT, silent, *m.MACHINES[2:])).collect())
    lex = m.Lexicon({"idiot": 4.0})
    one, strong, two = (m.document_weight(t, lex) for t in ("an idiot", "such an idiot", "an idiot idiot"))
    assert one < strong < two and math.isclose(strong, 1.3 * one) and math.isclose(two, 2.2 * one)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in table(spark, d, "labels").collect()}
    held = [r for r in q.op5_toxicity(spark, d).collect() if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted == 1 and truth[r.doc_id] == 1 for r in held)
    assert hit / sum(truth[r.doc_id] for r in held) > 0.8 and hit / max(1, sum(r.predicted for r in held)) > 0.9


def test_grammar_scores_clauses_not_words():
    from lodestone.llm.toxicity import Lexicon, document_weight

    lex = Lexicon({"idiot": 4.0})
    plain, aimed, denied, told = (document_weight(t, lex) for t in ("some idiot there", "you idiot", "not an idiot", "he said idiot"))
    assert denied < plain < aimed and told < aimed and document_weight("I will kill you", lex) > 0 == document_weight("kill time", lex)


def weight_brute(text, stems):
    """The grammar read from its description, machine by machine, without composing anything."""
    from lodestone.llm import toxicity as m

    total = 0.0
    for clause in m.CLAUSE.split((text or "").lower()):
        threat = negated = reported = aimed = strong = piled = 0  # words left of each scope
        quoted = False
        for raw in clause.split():
            w = raw.strip(m.STRIP)
            heads = [w, *(w[:n] + "-" for n in range(min(8, len(w) - 1), 3, -1))] if w else []
            stem = next((stems[h] for h in heads if h in stems), 0.0)
            is_threat = w in m.THREAT
            insult = 0.0 if is_threat else stem
            is_threat = is_threat or (not insult and "\x00" + w in stems)
            mark = not is_threat and not insult and m.QUOTE.search(raw)
            target = not is_threat and not insult and not mark and w in m.TARGET
            negation = not (is_threat or insult or mark or target) and w in m.NEGATION
            report = not (is_threat or insult or mark or target or negation) and w in m.REPORT
            more = not (is_threat or insult or mark or target or negation or report) and w in m.INTENSIFIER
            weight = insult * (1.5 if aimed else 1.0) * (1.3 if strong else 1.2 if piled else 1.0) + (m.THREAT_WEIGHT if target and threat else 0.0)
            total += weight * (0.4 if negated else 1.0) * (0.6 if reported or quoted else 1.0)
            aimed = 4 if target else max(0, aimed - 1)
            strong, piled = (2, 0) if more else (0, 3) if insult else (max(0, strong - 1), max(0, piled - 1))
            threat = 4 if is_threat else 0 if target else max(0, threat - 1)
            negated = 3 if negation else max(0, negated - 1)
            if mark:
                if reported or quoted:
                    reported = quoted = False
                else:
                    quoted = True
            elif report and not quoted:
                reported = True
    return total


def test_composed_grammar_equals_its_machines():
    from lodestone.llm.toxicity import GRAMMAR, Lexicon, document_weight

    rng, words = np.random.default_rng(8), ["idiot", "idiots!", "(scum)", "kill", "hurt,", "you", "they", "not", "never", "said", "wrote", '"quote', 'end"', "calm", "tree", ".", "\n", "x;y", "die", "sie", "such", "totally", "SO", "gut"]
    stems = {"idiot": 3.0, "scum": 1.25, "idio-": 0.5, "\x00gut": 1.0}
    for _ in range(2000):
        text = " ".join(rng.choice(words, rng.integers(0, 14)))
        assert math.isclose(document_weight(text, Lexicon(stems)), weight_brute(text, stems), abs_tol=1e-12), text
    assert len(GRAMMAR) > 50 and document_weight("die leute und sie", Lexicon(stems)) == 0 < document_weight("I will kill you", Lexicon({}))


def test_toxicity_scores_of_table(spark, sf):
    from lodestone.llm.toxicity import learn

    stems, (a, b) = learn(table(spark, sf, "documents"), table(spark, sf, "labels"))
    got = {r.doc_id: (r.score, r.predicted) for r in q.op5_toxicity(spark, sf).collect()}
    for r in table(spark, sf, "documents").collect():
        want = 1 / (1 + math.exp(-(a + b * math.log1p(weight_brute(r.text, stems))))) if stems else 0.0
        assert math.isclose(got[r.doc_id][0], want, rel_tol=1e-9) and got[r.doc_id][1] == int(want >= 0.3)


def test_grammar_sees_words_behind_marks():
    from lodestone.llm.toxicity import CLAUSE, Lexicon, clause_weight, document_weight

    lex = Lexicon({"idiot": 4.0})
    for t in ("*kill* you", "(kill) you", "I will kill, you", "Hey!idiot", "that.idiot", "calm words", "", "!?"):
        assert document_weight(t, lex) == sum(clause_weight([lex.symbol(w) for w in c.split()]) for c in CLAUSE.split(t.lower()))
        assert (document_weight(t, lex) > 0) == ("kill" in t or "idiot" in t)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_banded_distance():
    from lodestone.llm.line_dedup import _banded, edit_within

    rng = np.random.default_rng(5)
    for _ in range(3000):
        a = "".join(rng.choice(list("ab"), rng.integers(0, 9)))
        b = "".join(rng.choice(list("ab"), rng.integers(0, 9)))
        for k in (1, 2, 3):
            assert edit_within(a, b, k) == (distance(a, b) <= k)
            if a and b and abs(len(a) - len(b)) <= k:
                assert _banded(a, b, k) == (distance(a, b) <= k)


def lines_brute(rows, differ=2, least=8, near=20):
    strip = " \t\r\x0b\x0c"
    occ = [((i is None, i or 0, p), x.strip(strip)) for i, t in rows for p, x in enumerate((t or "").split("\n"))]
    first = {}
    for at, x in occ:
        first[x] = min(first.get(x, at), at)
    earliest = {x: min([first[x], *(first[y] for y in first if len(y) >= near and len(x) >= near and abs(len(x) - len(y)) <= differ and distance(x, y) <= differ)]) for x in first if len(x) >= least}
    out = []
    for i, t in rows:
        kept = [x for p, x in enumerate(t.split("\n")) if not (len(s := x.strip(strip)) >= least and earliest[s] < (i is None, i or 0, p))] if t is not None else None
        out.append((i, "\n".join(kept) if kept is not None else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [512, 4])
def test_line_dedup(spark, block):
    from lodestone.llm import line_dedup as m

    rng = np.random.default_rng(2)
    base = ["".join(rng.choice(list("abcdefgh "), rng.integers(18, 40))) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(4):
            x = list(base[rng.integers(12)])
            for _ in range(rng.integers(0, 4)):
                k = rng.integers(len(x))
                x[k : k + rng.integers(0, 2)] = [] if rng.random() < 0.3 else [str(rng.choice(list("xyz")))]
            lines.append("".join(x))
        rows.append((i, "\n".join([*lines, "ok", ""])))
    rows += [r for r in TEXTS if r[0] != 6]
    got = sorted(((r.doc_id, r.text) for r in m.line_dedup(docs(spark, rows), block=block).collect()), key=repr)
    assert got == lines_brute(rows)
    assert m.line_dedup(empty(spark)).collect() == []


def test_line_dedup_of_many_near_copies(spark):
    from lodestone.llm import line_dedup as m

    base = "the quick brown fox jumps over the lazy dog and then goes on its way home"
    near = [(i, f"{base[: i % 70]}{chr(97 + i % 26)}{base[i % 70 + 1 :]}{i // 70 % 10}\nown line number {'#' * (3 * i + 20)}") for i in range(2000)]
    far = [(5000 + i, f"{base[:30]} {i * 7919 % 100003:x}{i:08b}{i * 31 % 97}") for i in range(400)]  # one segment in common, not near
    got = {r.doc_id: r.n_lines_gone for r in m.line_dedup(docs(spark, near + far).repartition(6)).collect()}
    want = {i: 0 for i, _ in near + far}
    lines = sorted({(min(j for j, u in near if u.split("\n")[0] == x), x) for x in {t.split("\n")[0] for _, t in near}})
    first = {x: i for i, x in lines}
    late = {x: any(y[0] < first[x] and m.edit_within(y[1], x, 2) for y in lines) for x in first}
    for i, t in near:
        x = t.split("\n")[0]
        want[i] = int(late[x] or i > first[x])
    for k, (i, t) in enumerate(far):
        want[i] = int(any(m.edit_within(u, t, 2) for _, u in far[:k]))
    assert got == want and sum(want.values()) > 1900


def headed(n, seed, head=40, tail=24, share=0.1):
    """n lines with one beginning, of which a share are within two edits of another; otherwise they differ behind it."""
    rng, out = np.random.default_rng(seed), []
    begins = "".join(rng.choice(list("abcdefghij "), head))
    for _ in range(n):
        x = list(out[rng.integers(len(out))][head:]) if out and rng.random() < share else list(rng.choice(list("klmnopqrstuvwxyz0123456789"), tail + int(rng.integers(0, 3))))
        if out:
            for _ in range(rng.integers(0, 3)):
                x[rng.integers(len(x))] = str(rng.choice(list("klmnopqr")))
        out.append(begins + "".join(x))
    return out


def late_lines(lines, differ=2):
    """Places of lines that have an earlier one within differ edits, by a plain walk over halves of the tails."""
    from lodestone.llm.line_dedup import edit_within

    late, by_length = set(), defaultdict(list)
    for i, x in enumerate(lines):
        if any(edit_within(lines[j], x, differ) for n in range(len(x) - differ, len(x) + differ + 1) for j in by_length[n]):
            late.add(i)
        by_length[len(x)].append(i)
    return late


@pytest.mark.parametrize("block", [8, 60])
def test_line_dedup_of_common_beginnings(spark, block):
    """A hot segment whose lines mostly find no neighbour: blocks are small and unresolved lines many, so keys are refined."""
    from lodestone.llm import line_dedup as m

    lines = headed(700, 3) + [f"{'same words at both ends of all lines'}{a}{b}{'and nearly nothing in between them'}" for a in "0123456789" for b in "abcdefghij"]
    rows = [(i, f"{x}\nshort") for i, x in enumerate(lines)]
    late = late_lines(lines)
    got = {r.doc_id: r.n_lines_gone for r in m.line_dedup(docs(spark, rows).repartition(5), least=20, block=block).collect()}
    assert {i for i, n in got.items() if n} == late and 100 < len(late) < 300


def test_refined_keys_keep_every_near_pair():
    """Whatever two edits do to a line, the two lines meet under a key in every round that cuts."""
    from lodestone.llm import line_dedup as m

    rng = np.random.default_rng(9)
    for _ in range(200):
        a = "".join(rng.choice(list("abc"), int(rng.integers(20, 50))))
        b = list(a)
        for _ in range(int(rng.integers(0, 3))):
            k = int(rng.integers(len(b)))
            b[k : k + int(rng.integers(0, 2))] = [str(rng.choice(list("abcx")))] * int(rng.integers(0, 2))
        b = "".join(b)
        if not m.edit_within(a, b, 2):
            continue
        a, b = sorted((a, b), key=len)
        (ia, _), (ib, pb) = m.keys_of(a, 2), m.keys_of(b, 2)
        shared = set(ia) & (set(pb) | set(ib))
        level = {k: (m.first_views(a, k, 2), m.first_views(b, k, 2)) for k in shared}
        for _ in range(4):
            after: dict = {}
            for k, (va, vb) in level.items():
                for rest_a, n, i in va:
                    for rest_b, n_b, _ in vb:
                        if not i or n != n_b or n <= 6:
                            continue
                        xa, xb = m.next_views(k, rest_a, n, True, 2), m.next_views(k, rest_b, n, False, 2)
                        for (ka, ra), (na, ja) in xa.items():
                            for (kb, rb), (nb, jb) in xb.items():
                                if ka == kb and ja:
                                    x = after.setdefault(ka, (set(), set()))
                                    x[0].add((ra, na, ja))
                                    x[1].add((rb, nb, jb))
            if not after:
                assert all(n <= 6 for va, _ in level.values() for _, n, i in va if i) or not level
                break
            assert any(m.edit_within(ra, rb, 2) for va, vb in after.values() for ra, _, _ in va for rb, _, _ in vb)
            level = after


def test_line_dedup_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    occ = {}
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            occ.setdefault(x.strip(" \t\r\x0b\x0c"), []).append((i, p))
    from lodestone.llm.line_dedup import edit_within

    by_length, late = defaultdict(list), set()
    for x in occ:
        if len(x) >= 20:
            by_length[len(x)].append(x)
    for x in occ:
        if len(x) >= 20 and any(min(occ[y]) < min(occ[x]) and edit_within(x, y, 2) for n in range(len(x) - 2, len(x) + 3) for y in by_length[n]):
            late.add(x)
    want = {i: 0 for i, _ in rows}
    for x, at in occ.items():
        if len(x) >= 8:
            for place in at:
                want[place[0]] += x in late or place > min(at)
    got = {r.doc_id: (r.n_lines_gone, r.text) for r in q.op6_line_dedup(spark, sf).collect()}
    assert {i: n for i, (n, _) in got.items()} == want
    assert all((t or "").count("\n") == (got[i][1] or "").count("\n") + got[i][0] - (got[i][0] > 0 and not got[i][1] and (t or "").count("\n") + 1 == got[i][0]) for i, t in rows)


def filled(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        total, over = sum(w[s] for s in free), 0.0
        for s in list(free):
            target[s] += left * w[s] / total
        for s in list(free):
            if target[s] >= most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
        left = over
    return target


def test_mixing(spark, sf):
    for df in (docs(spark, [*TEXTS, (30, None)]), table(spark, sf, "documents")):
        from lodestone.llm.mixing import mix_sources

        rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
        sizes = defaultdict(int)
        for _, t, s in rows:
            sizes[s] += len(WORD.findall(t or ""))
        want, taken, out = filled(sizes, (5, 2, 1), 3), defaultdict(int), mix_sources(df).collect()
        assert len(out) == len(rows)
        for r in out:
            taken[r.source] += r.taken
            assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6) and r.taken <= 3 * r.size
        largest = {s: max(len(WORD.findall(t or "")) for _, t, x in rows if x == s) for s in sizes}
        assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
        assert sorted(map(repr, mix_sources(df).collect())) == sorted(map(repr, out))
    assert mix_sources(empty(spark)).collect() == []


def test_mixing_takes_the_pareto_order(spark, sf):
    """Which documents are taken, by plain Python from the same random numbers; some weights are so unequal that documents are certain."""
    from pyspark.sql import functions as F

    from lodestone.llm.mixing import mix_sources

    heavy = [(i, " ".join(["w"] * int(n)), f"s{i % 3}") for i, n in enumerate(np.random.default_rng(3).integers(1, 400, 240))]
    made = spark.createDataFrame(heavy, "doc_id long, text string, source string")
    sizes = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    for df, weight in ((table(spark, sf, "documents"), None), (made, F.pow(F.col("size"), 3))):
        u = (F.shiftrightunsigned(F.xxhash64("doc_id", "source", F.lit(7)), 11).cast("double") + 0.5) / float(1 << 53)
        rows = {r.doc_id: (r.source, r.n, r.u) for r in df.select("doc_id", "source", sizes.alias("n"), u.alias("u")).collect()}
        got = {r.doc_id: (r.copies, r.target) for r in mix_sources(df, weight=weight).collect()}
        some_sure = 0
        for s in {x[0] for x in rows.values()}:
            own = {i: (n, u, math.log1p(n) if weight is None else float(n) ** 3) for i, (x, n, u) in rows.items() if x == s}
            total, target = sum(n for n, _, _ in own.values()), next(got[i][1] for i in own)
            whole = math.floor(target / total + 1e-9)
            missing, sure = target - whole * total, set()
            while True:
                scale = (missing - sum(own[i][0] for i in sure)) / (sum(n * w for i, (n, _, w) in own.items() if i not in sure) or 1)
                more = {i for i, (n, _, w) in own.items() if scale > 0 and w * scale >= 1} - sure
                if not more:
                    break
                sure |= more
            some_sure += len(sure)
            left, taken = missing - sum(own[i][0] for i in sure), set(sure)

            def odds(i):
                n, u, w = own[i]
                p = min(1 - 1e-9, max(1e-9, scale * w))
                return u / (1 - u) / (p / (1 - p))

            upto = 0
            for i in sorted(set(own) - sure, key=odds):
                if left > 0 and upto + own[i][0] / 2 <= left and own[i][0]:
                    taken.add(i)
                upto += own[i][0]
                if upto >= left:
                    break
            assert {i: got[i][0] for i in own} == {i: whole + (i in taken) for i in own}, s
        assert weight is None or some_sure


def licence_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(k, label) for p, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    return len(words), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def licence_spans_brute(text, k=3, drift=3, share=0.6):
    """(first, last, label) of the spans that stay, and the score, one word and template at a time."""
    from lodestone.llm.license_scan import TEMPLATES

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = defaultdict(list)
    for p in range(len(words) - k + 1):
        at[tuple(words[p : p + k])].append(p)
    spans = []
    for t, (label, template) in enumerate(TEMPLATES):
        tw = template.split()
        votes = defaultdict(list)
        for j in range(len(tw) - k + 1):
            for p in at.get(tuple(tw[j : j + k]), ()):
                votes[p - j].append((p, j))
        group = []
        for d in [*sorted(votes), None]:
            if group and (d is None or d - group[-1] > drift):
                hits = [h for g in group for h in votes[g]]
                held = len({j for _, j in hits})
                if held / (len(tw) - k + 1) >= share:
                    spans.append((min(p for p, _ in hits), max(p for p, _ in hits) + k - 1, held, held / (len(tw) - k + 1), label, t))
                group = []
            group.append(d)
    won = defaultdict(int)
    for w in range(len(words)):
        over = [s for s in spans if s[0] <= w <= s[1]]
        if over:
            won[max(over, key=lambda s: (s[2], s[3], s[4], s[5], s[0]))] += 1
    kept = [s for s in won if won[s] * 2 > s[1] - s[0] + 1]
    return sorted((s[0], s[1], s[4]) for s in kept), max((s[3] for s in kept), default=0.0)


def test_license_spans_against_brute_force(spark, sf):
    from lodestone.llm.license_scan import TEMPLATES, license_scan

    rng, rows = np.random.default_rng(4), []
    for i in range(120):
        words = []
        for _ in range(rng.integers(1, 4)):
            t = TEMPLATES[rng.integers(len(TEMPLATES))][1].split()
            for _ in range(rng.integers(0, 4)):
                x = rng.integers(len(t))
                t[x : x + rng.integers(0, 2)] = [] if rng.random() < 0.5 else ["very"]
            words += [*t[: rng.integers(2, len(t) + 1)], *["word"] * int(rng.integers(0, 6))]
        rows.append((100 + i, " ".join(words)))
    rows += [
        (1, "released under the released under the"), (2, "Licensed under CC BY-NC-SA 4.0."), (3, "licensed under CC BY 4.0"), (4, "licensed under cc by sa 4 0 and licensed under cc by nc 4 0"),
        (5, "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"), (6, "released under the mit license " * 50), (7, ""), (8, None),
    ]
    for df in (docs(spark, rows), table(spark, sf, "documents")):
        texts = {r.doc_id: r.text for r in df.collect()}
        out = {r.doc_id: r for r in license_scan(df).collect()}
        for i, t in texts.items():
            spans, score = licence_spans_brute(t)
            base = licence_brute(t)[-1]
            assert sorted((x.first, x.last, x.label) for x in out[i].spans or []) == spans, (i, t)
            assert out[i].labels == ",".join(sorted({*filter(None, base.split(",")), *(x[2] for x in spans)}))
            assert math.isclose(out[i].score, max(score, 0.5 if base else 0.0))
        if 8 in texts and len(texts) == len(rows):
            assert [out[i].labels for i in (1, 2, 3, 4)] == ["", "cc-by-nc-sa", "cc-by", "cc-by-nc,cc-by-sa"] and len(out[6].spans) == 50


def test_license_scan(spark, sf):
    more = [(40, "Permission is hereby granted, free of charge, to any person obtaining a copy of this very software and associated documentation files (the \"Software\"), to deal in the Software without restriction"), (41, "mit mit license license K Mit.License"), (42, "MIT LICENSE École apache license")]
    for rows, df in [([*TEXTS, *more], docs(spark, [*TEXTS, *more])), (None, table(spark, sf, "documents"))]:
        from lodestone.llm.license_scan import license_scan

        rows = rows or [tuple(r) for r in df.select("doc_id", "text").collect()]
        out = license_scan(df).collect()
        assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out], key=repr) == sorted([(i, *licence_brute(t)) for i, t in rows], key=repr)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)
        if rows[-1][0] == 42:
            assert next(r for r in out if r.doc_id == 40).labels == "mit"
    assert license_scan(empty(spark)).collect() == []


def test_topk(spark):
    from lodestone.llm.topk_search import topk_search

    rng = np.random.default_rng(4)
    rows = [(i, np.float32(rng.integers(-3, 4, 5) / 4).tolist(), 0) for i in range(300)] + [(1000, None, 0), (1100, [float("nan")] * 5, 0), (1200, [1.0, None, 0.0, 0.0, 0.0], 0), (1300, [float(np.float32(1e12))] * 5, 0)]
    df = vectors(spark, rows)
    got = sorted(map(tuple, topk_search(df, df.where("vec_id % 100 = 0"), 10, tile_rows=37, fan=3).collect()))
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v, _ in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for i, v in ok:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, u)), j) for j, u in ok if j != i)[:10]
            want += [(i, k + 1, j, max(-(2**63), min(2**63 - 1, -s))) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)
    assert got == sorted(map(tuple, topk_search(df, df.where("vec_id % 100 = 0"), 10, tile_rows=37, fan=3, ask_bytes=100).collect()))
    assert topk_search(df.limit(0), df.limit(0)).collect() == []


def simhash_brute(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(words)
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("block", [4096, 4])
def test_simhash(spark, sf, block):
    from lodestone.llm import simhash as m

    base = " ".join(f"t{i}" for i in range(400))
    rows = [*[r for r in TEXTS if r[0] is not None and r[0] != 8], *[(100 + i, base.replace(f"t{7 * i} ", "zz ")) for i in range(40)]]
    prints = m.fingerprints(docs(spark, rows))
    got = {r.doc_id: r.fp & (2**64 - 1) for r in prints.collect()}
    assert got == {i: simhash_brute(t) for i, t in rows}
    links = m.fingerprint_links(prints, 4, block)
    edges = [(r.u & (2**64 - 1), r.v & (2**64 - 1)) for r in links.collect()]
    fps = sorted(set(got.values()))
    pairs = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    assert components(fps, edges) == components(fps, pairs) and pairs
    out = {r.doc_id: r.component_id for r in m.simhash_components(docs(spark, rows)).collect()}
    ids = sorted(got)
    assert out == components(ids, [(a, b) for a in ids for b in ids if a < b and (got[a] ^ got[b]).bit_count() <= 4])
    assert m.simhash_components(empty(spark)).collect() == []


def test_simhash_table(spark, sf):
    rows = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in q.op10_simhash_dedup(spark, sf).collect()}
    fp = {i: simhash_brute(t) for i, t in rows.items()}
    of = components(sorted(fp), [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert got == {i: (f"{fp[i]:016x}", of[i]) for i in fp}


def shingles_brute(text, width=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def copies_brute(rows, similarity=0.8):
    """The rows that stay: those of the smallest doc_id of each group of similar texts, and those without one."""
    texts = sorted({(t or "") for i, t in rows if i is not None})
    sets = [shingles_brute(t) for t in texts]
    pairs = [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    of, least = components(range(len(texts)), pairs), {}
    for i, t in rows:
        if i is not None:
            c = of[texts.index(t or "")]
            least[c] = min(least.get(c, i), i)
    return sorted(((i, t) for i, t in rows if i is None or least[of[texts.index(t or "")]] == i), key=repr)


def edited(words, spots):
    return " ".join(f"new{i}" if i in spots else w for i, w in enumerate(words))


def test_pipeline_drops_copies_at_similarity(spark, sf):
    import corpus_pipeline as p

    rng, rows = np.random.default_rng(7), [r for r in TEXTS if r[0] != 6]
    for k in range(60):  # originals with a copy of 1 to 4 edited words: similarities from 0.6 to 0.98, on both sides of the bound
        words = [f"v{k}x{x}" for x in rng.integers(0, 5000, int(rng.integers(60, 220)))]
        rows += [(1000 + 3 * k, " ".join(words)), (1001 + 3 * k, edited(words, set(rng.choice(len(words), 1 + k % 4, replace=False).tolist())).upper())]
    words = [f"c{x}" for x in range(200)]
    rows += [(2000 + k, edited(words, set(range(5 * k, 5 * k + 4)))) for k in range(12)] + [(None, " ".join(words)), (2100, "a b"), (2101, "A  b"), (2102, "a c"), (2103, ""), (2104, None)]
    df = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    got = sorted(((r.doc_id, r.text) for r in p.drop_copies(spark, df.repartition(3), sf).collect()), key=repr)
    want = copies_brute(rows)
    assert got == want and 20 < len(want) < len(rows) - 40


def test_similar_components_with_hot_keys(spark):
    """Keys that many fingerprints share, in one task's rows or over all, are dealt to blocks; nothing is lost by it."""
    from lodestone.llm.simhash_similar import similar_components

    rng = np.random.default_rng(17)
    words = [f"h{x}" for x in range(300)]
    rows = [(k, edited(words, set(rng.choice(300, 3, replace=False).tolist())) + f" tail{k}") for k in range(160)]  # one large group of near copies, all distinct
    rows += [(1000 + k, " ".join(f"u{x}" for x in rng.integers(0, 9000, 120))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def found(hot, many, parts):
        return sorted((r.doc_id, r.component_id) for r in similar_components(df.repartition(parts), hot=hot, many=many).collect())

    want = found(1024, 1 << 30, 3)
    assert len({c for _, c in want}) < 70
    for hot, many, parts in ((8, 1 << 30, 3), (1024, 4, 1), (20, 6, 5)):
        assert found(hot, many, parts) == want, (hot, many)


def test_pipeline_drops_copies_of_table(spark, sf):
    import corpus_pipeline as p

    df = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(((r.doc_id, r.text) for r in p.drop_copies(spark, df, sf).collect()), key=repr) == copies_brute(rows)


def test_components(spark):
    from lodestone.llm.components import connected_components

    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    assert got == components(sorted({n for e in edges for n in e}), edges)


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs_ = table(spark, sf, "documents")
    columns, before = docs_.columns, docs_
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == columns, name
        after = spark.createDataFrame(after.collect(), docs_.schema)
        if name in ("toxicity", "line_dedup"):
            assert after.select("doc_id").distinct().count() >= (0.5 if name == "toxicity" else 1.0) * before.count()
        before = after
    out = p.STAGES[-1][1](spark, before, sf).collect()
    assert check_packing(out, 2048) and sum(r.length for r in out if r.doc_id is not None) > 0
    odd = docs(spark).select(*columns)
    for name, stage in p.STAGES:
        assert stage(spark, odd, sf).count() > 0 and stage(spark, odd.limit(0), sf).count() == 0


def test_pipeline_stages_against_plain_versions(spark, sf):
    """The rows that the toxicity, line and mixing stages return, by plain Python over what each is given."""
    import corpus_pipeline as p
    from lodestone.llm.line_dedup import edit_within
    from lodestone.llm.mixing import mix_sources
    from lodestone.llm.toxicity import learn

    docs_ = table(spark, sf, "documents")
    rows = [tuple(r) for r in docs_.select(*p.COLUMNS).collect()]
    stems, (a, b) = learn(docs_, table(spark, sf, "labels"))
    clean = sorted((r for r in rows if not stems or 1 / (1 + math.exp(-(a + b * math.log1p(weight_brute(r[1], stems))))) < 0.3), key=repr)
    assert sorted((tuple(r) for r in p.drop_toxic(spark, docs_, sf).collect()), key=repr) == clean
    occ, by_length = defaultdict(list), defaultdict(list)
    for r in clean:
        for n, line in enumerate((r[1] or "").split("\n")):
            occ[line.strip(" \t\r\x0b\x0c")].append((r[0], n))
    for x in occ:
        by_length[len(x)].append(x)
    late = {x for x in occ if len(x) >= 20 and any(min(occ[y]) < min(occ[x]) and edit_within(x, y, 2) for n in range(max(20, len(x) - 2), len(x) + 3) for y in by_length[n])}
    want = []
    for i, text, lang, source, n_chars in clean:
        kept = None if text is None else "\n".join(x for n, x in enumerate(text.split("\n")) if len(s := x.strip(" \t\r\x0b\x0c")) < 8 or not (s in late or (i, n) > min(occ[s])))
        want.append((i, kept, lang, source, n_chars if kept is None else len(kept)))
    given = spark.createDataFrame(clean, docs_.select(*p.COLUMNS).schema)
    assert sorted((tuple(r) for r in p.drop_lines(spark, given, sf).collect()), key=repr) == sorted(want, key=repr)
    copies = {r.doc_id: r.copies for r in mix_sources(given).collect()}
    assert sorted((tuple(r) for r in p.mix(spark, given, sf).collect()), key=repr) == sorted((r for r in clean for _ in range(copies[r[0]])), key=repr)


def test_pipeline_mix_keeps_rows_without_id_apart(spark, sf):
    import corpus_pipeline as p

    rows = [(None, "a b c", "en", "x", 5), (None, "d e f g h i", "en", "y", 11), (1, "j k", "en", "x", 3), (1, "l m n o", "en", "x", 7), (2, "p q", "en", None, 3)]
    docs_ = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [tuple(r) for r in p.mix(spark, docs_, sf).collect()]
    assert set(out) <= set(rows) and all(out.count(r) <= 3 for r in rows)


def test_materialized_tables_can_be_cleaned(spark):
    from lodestone.llm.common import clean, materialize

    df = materialize(spark.range(3).toDF("x"))
    assert df.count() == 3 and clean(spark) and not clean(spark)


def test_token_ids_equal_the_tokenizers_form():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    from lodestone.llm.packing import Coder

    tok, code = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), Coder(q.vocabulary())
    some = st.text(alphabet=st.sampled_from(list("aB1é中 \n\t.'sʼ’ \u0085  \x1c\x00<|>endoftx")), max_size=40)

    @settings(max_examples=600, deadline=None)
    @given(some | st.text(max_size=30))
    def same(text):
        assert np.frombuffer(code.ids(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids

    same()
    assert np.frombuffer(code.ids("x <|endoftext|> y"), "<u4").tolist() == tok.encode("x <|endoftext|> y", add_special_tokens=False).ids


def test_word_windows_against_plain_hashes():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from lodestone.llm import substring_dedup as m

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list("ab é\n ")), max_size=30), min_size=1, max_size=4))
    def same(texts):
        data = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, data)])
        starts, ends, first = m.words_of(np.frombuffer(b"".join(data), np.uint8), offsets)
        want = [w for d in data for w in d.split()]
        assert [b"".join(data)[a:b] for a, b in zip(starts, ends)] == want and np.diff(first).tolist() == [len(d.split()) for d in data]
        h = m.word_hashes(np.frombuffer(b"".join(data), np.uint8), starts, ends)
        assert len(set(h.tolist())) == len(set(want)) and all(len({h[i] for i in range(len(want)) if want[i] == w}) == 1 for w in set(want))
        g = m.window_hashes(h, 2)
        grams = [tuple(want[i : i + 2]) for i in range(len(want) - 1)]
        assert len(g) == len(grams) and len(set(g.tolist())) == len(set(grams))

    same()


def test_packing_searches_every_level_alike(spark, monkeypatch):
    """As many epochs whatever the number of shards."""
    from lodestone.llm import packing

    seen, real = [], packing.grouped_shards

    def watched(items, size, islands=3, epochs=3):
        seen.append(epochs)
        return real(items, size, islands, 0)

    monkeypatch.setattr(packing, "grouped_shards", watched)
    pieces = spark.range(60).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "7 + id % 5 AS length", "id AS ids_crc32", "0 AS copy")
    assert packing.pack_pieces(pieces, 20, shard=10).count() == 60
    assert len(seen) > 0 and set(seen) == {3}
