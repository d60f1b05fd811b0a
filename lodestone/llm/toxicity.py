"""Toxicity by a weighted finite-state pattern grammar.

A clause (text between sentence marks or line ends) is a string of symbols, one a word: insult, intensifier, threat, target,
negation, report, quotation, other. Transducers for insult, threat, negation, reported speech and aim each give a factor
for each symbol by their state: an insult weighs what its stem weighs, more behind an intensifier and more again in a pile of
insults; more behind a target; a threat weighs when its target follows within a few words; negation damps its scope, a report
or a quotation what it reports. They are composed
once into one table of joint states, which scores matched clauses, not isolated words. Clause weights add up to a
document's weight, and a logistic curve makes a score of it. Insult stems (whole words and word beginnings of 4 to 8
letters), threats beyond the given ones (words right before a target) and the curve are learnt: stems and threats by their
smoothed log odds between labelled documents, less their standard error. The fit takes a sample of at most `sample` labelled rows, by a hash of doc_id; scoring covers whole texts.

Defined results: null and empty texts have weight 0 and its score; very long texts are scored like others, clause by
clause; of a doc_id's labels any 1 counts; repeated rows are scored each; with no labels of both kinds every score is 0;
columns named weight, score, predicted or held_out are replaced, all others stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Closed classes of words that the grammar looks at.
TARGET = set("you your yours u he she they them him her those these people du dich euch ihr sie er tu vous toi il elle ils tú usted ustedes él ella ellos".split())
NEGATION = set("not no never nobody isn't aren't wasn't don't doesn't didn't without nicht kein keine nie pas jamais aucun nunca jamás ningún".split())
REPORT = set("said says say claimed claims wrote called quoted quote reported reportedly allegedly sagte schrieb dit écrit dijo escribió".split())
THREAT = set("kill hurt destroy beat burn hang shoot strangle stab töten umbringen schlagen tuer frapper matar golpear".split())
INTENSIFIER = set("such so very really total totally complete completely utter utterly absolute absolutely damn bloody fucking sehr so völlig total absolut verdammt très tellement complètement totalement vraiment espèce muy tan totalmente completamente pedazo".split())
CLAUSE = re.compile(r"[.;!?\n]+")
STRIP = "\"'`.,;:!?()[]{}<>«»„“”‘’-*_#$%&|"
QUOTE = re.compile("[\"«»„“”]")

#: Transducers: state -> symbol -> (next state, factor on what this symbol weighs); '*' stands for symbols not named.
#: Symbols: I insult, M intensifier, T threat, Y target, N negation, R report, Q quotation mark, O other. State 0 is the first.
#: Insult: states 1 and 2 follow an intensifier by up to two words, 3 to 5 another insult by up to three.
INSULT = {
    0: {"M": (2, 1.0), "I": (5, 1.0), "*": (0, 1.0)}, **{k: {"M": (2, 1.0), "I": (5, 1.3), "*": (k - 1, 1.0)} for k in (2, 1)},
    **{k: {"M": (2, 1.0), "I": (5, 1.2), "*": (k - 1 if k > 3 else 0, 1.0)} for k in (5, 4, 3)},
}
THREATEN = {0: {"T": (4, 0.0), "Y": (0, 0.0), "*": (0, 1.0)}, **{k: {"T": (4, 0.0), "Y": (0, 1.0), "*": (k - 1, 1.0)} for k in (4, 3, 2, 1)}}
NEGATE = {0: {"N": (3, 1.0), "*": (0, 1.0)}, **{k: {"N": (3, 1.0), "*": (k - 1, 0.4)} for k in (3, 2, 1)}}
REPORTED = {0: {"R": (1, 1.0), "Q": (1, 1.0), "*": (0, 1.0)}, 1: {"Q": (0, 1.0), "*": (1, 0.6)}}
AIMED = {0: {"Y": (4, 1.0), "*": (0, 1.0)}, **{k: {"Y": (4, 1.0), "I": (k - 1, 1.5), "*": (k - 1, 1.0)} for k in (4, 3, 2, 1)}}
MACHINES = (INSULT, THREATEN, NEGATE, REPORTED, AIMED)
SYMBOLS = "IMTYNRQO"
#: What symbols weigh before factors: an insult what its stem weighs, a target that a threat reaches as much as a strong stem.
THREAT_WEIGHT = 2.0
#: Begins the name of what is counted for words right before a target.
THREATENS = "\x00"


def compose(machines: tuple[dict, ...]) -> list[dict[str, tuple[int, float]]]:
    """One table over the joint states that can be reached: state -> symbol -> (next state, product of factors)."""
    number, table, todo = {(0,) * len(machines): 0}, [], [(0,) * len(machines)]
    for joint in todo:
        row = {}
        for symbol in SYMBOLS:
            moves = [m[s].get(symbol, m[s]["*"]) for m, s in zip(machines, joint)]
            to = tuple(n for n, _ in moves)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row[symbol] = (number[to], math.prod(f for _, f in moves))
        table.append(row)
    return table


GRAMMAR = compose(MACHINES)


def clause_weight(symbols: list[tuple[str, float]], grammar: list = GRAMMAR) -> float:
    """Runs the composed grammar over (symbol, weight) of a clause's words."""
    state, total = 0, 0.0
    for symbol, weight in symbols:
        state, factor = grammar[state][symbol]
        if weight:
            total += weight * factor
    return total


class Lexicon(dict):
    """Weight of each word as it stands in a text, by its longest known stem; 0 if none. Stems that begin with THREATENS are learnt threats."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems
        self.threats = THREAT | {f[len(THREATENS) :] for f in stems if f.startswith(THREATENS)}

    def __missing__(self, raw: str) -> float:
        if len(self) > 100_000:
            self.clear()
        w = raw.strip(STRIP)
        out = next((self.stems[f] for f in features(w) if f in self.stems), 0.0)
        self[raw] = out
        return out

    def symbol(self, raw: str) -> tuple[str, float]:
        w = raw.strip(STRIP)
        if w in THREAT:
            return "T", 0.0
        if self[raw]:
            return "I", self[raw]
        if w in self.threats:
            return "T", 0.0
        if QUOTE.search(raw):
            return "Q", 0.0
        return ("Y", THREAT_WEIGHT) if w in TARGET else ("N" if w in NEGATION else "R" if w in REPORT else "M" if w in INTENSIFIER else "O", 0.0)


def features(word: str) -> list[str]:
    """A word and its beginnings, longest first; beginnings are marked."""
    return [word, *(word[:n] + "-" for n in range(min(8, len(word) - 1), 3, -1))] if word else []


def document_weight(text: str, lexicon: Lexicon, grammar: list = GRAMMAR) -> float:
    """The sum over clauses that hold an insult or a threat."""
    clauses = [c.split() for c in CLAUSE.split(text.lower())]
    # quick exit: no word weighs, split and stripped as the grammar has them
    if not any(any(map(lexicon.__getitem__, c)) or not lexicon.threats.isdisjoint([w.strip(STRIP) for w in c]) for c in clauses):
        return 0.0
    return sum(clause_weight([lexicon.symbol(w) for w in c], grammar) for c in clauses)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def aimed_words(words: list[str]) -> set[str]:
    """The words right before a target, as names of threats."""
    bare = [w.strip(STRIP) for w in words]
    return {THREATENS + a for a, b in zip(bare, bare[1:]) if b in TARGET and a and a not in TARGET}


def _counter(batches):
    """Documents of each label that hold each feature, summed in the task before they are sent."""
    found: Counter = Counter()

    def flush():
        if found:
            names = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([n[0] for n in names]), pa.array([n[1] for n in names], pa.int32()), pa.array([found[n] for n in names], pa.int64())], ["f", "y", "n"])
            found.clear()

    for batch in batches:
        for t, y in zip(batch.column(0), batch.column(1).to_pylist()):
            words = (t.as_py() or "").lower().split()
            found.update((f, y) for f in {f for w in set(words) for f in features(w.strip(STRIP))} | aimed_words(words))
            if len(found) > 300_000:
                yield from flush()
    yield from flush()


def own_weight(found: list[tuple[str, int, int]], bad: int, good: int, support: int) -> dict[str, float]:
    """Weights of stems (stem, documents of either kind); a beginning weighs by the documents that its longer stems do not explain."""
    out: dict[str, tuple[float, int, int]] = {}
    for f, b, g in sorted(found, key=lambda x: (-len(x[0].rstrip("-")), x[0][-1] == "-", x[0])):
        if f[-1] == "-":
            longer = [v for x, v in out.items() if x.startswith(f[:-1])]
            b, g = b - sum(v[1] for v in longer), max(0, g - sum(v[2] for v in longer))
            if b < support:
                continue
        w = math.log((b + 0.5) / (bad + 1)) - math.log((g + 0.5) / (good + 1)) - math.sqrt(1 / (b + 0.5) + 1 / (g + 0.5)) - 2
        if w > 0:
            out[f] = (w, b, g)
    return {f: v[0] for f, v in out.items()}


def learn(docs: DataFrame, labels: DataFrame, sample: int = 12_000, stems: int = 4096, support: int = 4, machines: tuple[dict, ...] = MACHINES) -> tuple[dict[str, float], tuple[float, float]]:
    """Weights of stems and threats (at most `stems`) and the curve, from rows of labels (doc_id, toxic) that are not held out."""
    grammar = compose(machines)
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = usable.count()
    share = min(1.0, sample * 0.95 / max(1, n))
    chosen = usable.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_kind = {r[0]: r[1] for r in chosen.groupBy("toxic").count().collect()}
    bad, good = by_kind.get(1, 0), by_kind.get(0, 0)
    if not bad or not good:
        return {}, (-40.0, 0.0)
    sums = rows.mapInArrow(_counter, "f string, y int, n long").groupBy("f").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 1, 0).otherwise(F.col("n"))).alias("good"))
    # what a stem weighs: by how much its log odds, less their standard error, exceed 2
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    weight = odds - F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5)) - 2
    top = sums.where((F.col("bad") >= support) & (weight > 0)).select("f", weight.alias("w"), "bad", "good").orderBy(F.desc(F.col("w") * F.sqrt("bad")), "f").limit(stems).collect()
    lexicon = own_weight([(r["f"], r["bad"], r["good"]) for r in top if not r["f"].startswith(THREATENS)], bad, good, support)
    # a word that is an insult anywhere is none of the threats
    known = Lexicon(lexicon)
    lexicon |= {r["f"]: r["w"] for r in top if r["f"].startswith(THREATENS) and not known[r["f"][len(THREATENS) :]]}

    def weigh(batches):
        lex = Lexicon(lexicon)
        for batch in batches:
            w = [document_weight(t.as_py() or "", lex, grammar) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.float64()), batch.column(1).cast(pa.int32())], ["w", "y"])

    pairs = rows.mapInArrow(weigh, "w double, y int").collect()  # two numbers a sampled row
    return lexicon, fit_curve(np.array([r[0] for r in pairs]), np.array([r[1] for r in pairs], float))


def fit_curve(w: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Logistic regression of labels on log(1 + weight), with a little ridge."""
    x, a, b = np.log1p(w), -2.0, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        g = np.array([(p - y).sum(), ((p - y) * x).sum() + 0.1 * b])
        v = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[v.sum() + 1e-6, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.1]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def score_toxicity(docs: DataFrame, model: tuple[dict[str, float], tuple[float, float]], machines: tuple[dict, ...] = MACHINES) -> DataFrame:
    """docs with weight and score (0 to 1); other columns stay, those of these names are replaced."""
    (lexicon, (a, b)), grammar = model, compose(machines)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)  # at most `stems` entries

    @F.pandas_udf("double")
    def weight(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lex = Lexicon(shared.value)
        for text in texts:
            yield pd.Series([document_weight(t or "", lex, grammar) for t in text], dtype="float64")

    w = F.col("weight")
    return docs.withColumn("weight", weight(F.col("text"))).withColumn("score", F.when(F.lit(not lexicon), 0.0).otherwise(1 / (1 + F.exp(-(a + b * F.log1p(w))))))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, machines: tuple[dict, ...] = MACHINES) -> DataFrame:
    """docs with score and predicted (1 if score >= threshold). Fewer machines tell what each is worth."""
    scored = score_toxicity(docs, learn(docs, labels, machines=machines), machines)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumn("held_out", held_out(F.col("doc_id")))
