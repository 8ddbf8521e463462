"""Toxicity with a weighted finite-state pattern grammar.

All machines are sequential letter transducers (`Transducer`), put together by composition (`composed`).  The *lexicon*
turns words into symbols: insults and threats with weights learned from labelled rows (whole words and stems, a stem
being a word's first letters), targets, negations and words of reported speech from the fixed lists below.  Over a
clause's symbols run four context machines: one from right to left, which marks insults and threats that a target
follows nearby, and from left to right the composition of three, which mark those that a target precedes, that a
negation reaches, and that stand in reported speech.  What comes out is a match: an insult or a threat, aimed or not,
asserted, negated or reported.  Each of these twelve kinds has a tape that sums the weights of its matches; a logistic
layer over the tapes and the number of clauses that assert something gives the score.  No word counts but through a
match.  The layer is learned from the same labelled rows and pulled towards PRIOR, so that kinds of matches the sample
doesn't show keep a sensible weight.

Learning uses a bounded sample: about LEARN labelled texts, picked by a hash of doc_id, repeated texts once (toxic if
one of them is marked so).  Every entry of the sample that passes the tests of `_chosen` is kept, however many.  Every
text is scored whole.  Null and empty texts get the score of a text without a match.  Without labels the fixed lists
alone decide.  A null doc_id is kept and never learned from.  Repeated rows yield repeated rows.  Extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEARN, STEMS, CACHE, REACH = 16_000, range(4, 9), 400_000, 3
#: The seed lists of the lexicon.
INSULTS = "idiot moron loser stupid worthless pathetic disgusting scum trash clown".split()
THREATS = "kill hurt destroy beat shoot stab burn punish töten schlagen tuer frapper matar golpear".split()
TARGETS = "you your yours u he she they them him her du dich dir ihr euch sie tu te toi vous il elle ils usted ustedes él ella ellos".split()
NEGATIONS = "not never no isn't aren't don't nicht kein keine nie pas jamais ne nunca jamás".split()
REPORTS = "said says say wrote writes quoted claimed called alleged sagte schrieb dit écrit dijo escribió".split()
#: Scripts written without blanks (Thai, Lao, Burmese, Khmer, kana, Han).
RUN = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[^\W\d_{RUN}]+(?:'[^\W\d_{RUN}]+)?|[{RUN}]+")
UNSPACED = re.compile(f"[{RUN}]")
CLAUSE = re.compile(r"[.!?;:\n]+")
KINDS, AIMS, MOODS = ("insult", "threat"), ("plain", "aimed"), ("asserted", "negated", "reported")
TAPES = [(k, a, m) for k in KINDS for a in AIMS for m in MOODS]
#: Weights of the tapes, of one and of two clauses that assert something, before anything is learned; and the bias.
PRIOR = [*({"asserted": 0.8, "negated": -0.3, "reported": 0.0}[m] + (0.4 if a == "aimed" and m == "asserted" else 0.0) for k, a, m in TAPES), 0.5, 1.0]
BIAS = -2.5
SCHEMA = "doc_id long, score double, predicted int, matches int"


def words_of(text: str) -> list[str]:
    """All words of a lower-cased text, whatever stands between them; a run of an unspaced script counts as its pairs of letters."""
    found = WORD.findall(text)
    if text.isascii() or not UNSPACED.search(text):
        return found
    out = []
    for w in found:
        out += [w[i : i + 2] for i in range(max(1, len(w) - 1))] if UNSPACED.match(w) else [w]
    return out


class Transducer:
    """A sequential letter transducer: `arcs[state][symbol]` is (next state, symbol written); state 0 begins."""

    def __init__(self, symbols, start, step):
        """All states that `step(state, symbol) -> (state, symbol written)` reaches from `start`."""
        number, todo, self.arcs = {start: 0}, [start], []
        while len(self.arcs) < len(todo):
            row = {}
            for symbol in symbols:
                state, written = step(todo[len(self.arcs)], symbol)
                if state not in number:
                    number[state] = len(todo)
                    todo.append(state)
                row[symbol] = (number[state], written)
            self.arcs.append(row)

    def run(self, symbols: list[str]) -> list[str]:
        state, out, arcs = 0, [], self.arcs
        for symbol in symbols:
            state, written = arcs[state][symbol]
            out.append(written)
        return out


def composed(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that writes what `second` writes when it reads what `first` writes."""

    def step(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str]:
        a, middle = first.arcs[state[0]][symbol]
        b, written = second.arcs[state[1]][middle]
        return (a, b), written

    return Transducer(first.arcs[0], (0, 0), step)


#: Symbols: any word, target, negation, reported speech, insult, threat; marks of a match: aimed, negated, reported.
WORDS, MATCHES, MARKS = ".tnr", "ik", "a-q"
SYMBOLS = [*WORDS, *(m + "".join(x for k, x in enumerate(MARKS) if bits >> k & 1) for m in MATCHES for bits in range(1 << len(MARKS)))]


def _marker(opener: str, mark: str, reach: int | None) -> Transducer:
    """Marks the matches within `reach` words after an opener, or all to the clause's end."""

    def step(left: int, symbol: str) -> tuple[int, str]:
        if symbol == opener:
            return reach or 1, symbol
        marked = symbol + mark if symbol[0] in MATCHES and left and mark not in symbol else symbol
        return (left if reach is None else max(0, left - 1)), "".join(sorted(marked, key=(MATCHES + MARKS).find)) if symbol[0] in MATCHES else symbol

    return Transducer(SYMBOLS, 0, step)


#: From right to left, and from left to right.
AHEAD = _marker("t", "a", REACH)
GRAMMAR = composed(composed(_marker("t", "a", REACH), _marker("n", "-", REACH)), _marker("r", "q", None))
TAPE_OF = {s: TAPES.index((KINDS[MATCHES.index(s[0])], AIMS["a" in s], MOODS[1 if "-" in s else 2 if "q" in s else 0])) for s in SYMBOLS if s[0] in MATCHES}


def matches(symbols: list[str]) -> list[int]:
    """The tape of each symbol of a clause that is a match, in order."""
    return [TAPE_OF[s] for s in GRAMMAR.run(AHEAD.run(symbols[::-1])[::-1]) if s[0] in MATCHES]


class Lexicon:
    """From words to (symbol, weight): whole words first, then the longest stem."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        kind = lambda w: "k" if any(t.startswith(w) or w == t for t in THREATS) else "i"
        self.words = {w: (kind(w), v) for w, v in words.items()}
        for symbol, group in (("t", TARGETS), ("n", NEGATIONS), ("r", REPORTS)):
            for w in group:
                self.words.setdefault(w, (symbol, 0.0))
        self.stems = {s: (kind(s), v) for s, v in stems.items()}
        self.cache: dict[str, tuple[str, float]] = {}

    def read(self, word: str) -> tuple[str, float]:
        """Of a lower-cased word."""
        got = self.cache.get(word)
        if got is None:
            got = self.words.get(word)
            for n in reversed(STEMS):
                if got is None and len(word) >= n:
                    got = self.stems.get(word[:n])
            if len(self.cache) >= CACHE:
                self.cache.clear()
            got = self.cache[word] = got or (".", 0.0)
        return got


def _features(text: str, lexicon: Lexicon) -> tuple[list[float], int]:
    """Of a whole text: log of each tape's sum, whether one clause and whether two assert something; and the number of matches."""
    low, read = text.lower(), lexicon.read
    if not any(read(w)[0] in MATCHES for w in set(words_of(low))):
        return [0.0] * (len(TAPES) + 2), 0
    tapes, found, asserted = [0.0] * len(TAPES), 0, 0
    for clause in CLAUSE.split(low):
        symbols = [read(w) for w in words_of(clause)]
        weights = [v for s, v in symbols if s in MATCHES]
        if weights:
            on = matches([s for s, _ in symbols])
            for tape, weight in zip(on, weights, strict=True):
                tapes[tape] += weight
            found += len(on)
            asserted += any(TAPES[t][2] == "asserted" for t in on)
    return [*(math.log1p(t) for t in tapes), float(asserted > 0), float(asserted > 1)], found


def _entries(text: str) -> set[str]:
    """A text's words, and its stems with a star."""
    words = set(words_of(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) > n}


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray, bias: float):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def score(self, text: str) -> tuple[float, int]:
        f, found = _features(text, self.lexicon)
        return float(1 / (1 + math.exp(-max(-500.0, min(500.0, float(np.dot(self.weights, f)) + self.bias))))), found


def _chosen(counts: list[tuple[str, int, int]], pos: int, neg: int) -> tuple[dict, dict]:
    """Words and stems with their weights (log odds ratios) out of (entry, texts with label 1, texts with label 0)."""
    least = max(3, pos // 200)
    odds = sorted(((math.log((p + 0.1) / (pos + 0.2)) - math.log((n + 0.1) / (neg + 0.2)), p, e) for e, p, n in counts if p >= least), reverse=True)
    odds = [(o, p, e) for o, p, e in odds if o >= 2.5]
    found = {e: p for _, p, e in odds}
    # a stem gives way to a longer one, or to a word, that has nearly all its texts
    better = {f"{e.rstrip('*')[:n]}*" for e, p in found.items() for n in STEMS if n < len(e.rstrip("*")) + (not e.endswith("*")) and p >= 0.9 * found.get(f"{e.rstrip('*')[:n]}*", p + p)}
    stems: dict[str, float] = {}
    for o, p, e in sorted(odds, key=lambda x: (len(x[2]), x[2])):
        if e.endswith("*") and p >= 2 * least and e not in better and not any(e[:n] in stems for n in STEMS if n < len(e)):
            stems[e[:-1]] = o
    return {e: o for o, p, e in odds if not e.endswith("*") and not any(e[:n] in stems for n in STEMS)}, stems


def fit(documents: DataFrame, labels: DataFrame, training: Column) -> Model:
    """Learns from a bounded sample of the rows of `labels` where `training` (a condition on doc_id) holds."""
    known = labels.where(training & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), (F.col("toxic") > 0).cast("int").alias("y"))
    count = known.count()
    seed = {w: 4.0 for w in (*INSULTS, *THREATS)}
    plain = Model(Lexicon(seed, {}), np.array(PRIOR), BIAS)
    if not count:
        return plain
    picked = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < min(1.0, LEARN / count) * (1 << 30))
    picked = documents.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).where("text is not null").groupBy("text").agg(F.max("y").alias("y")).select("y", "text")

    def counted(batches):
        for b in batches:
            both = (Counter(), Counter())
            totals = [0, 0]
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                both[y].update(_entries(t))
                totals[y] += 1
            keys = list(both[1])  # an entry is learned from texts with label 1; others only lower it
            rest = [k for k in both[0] if k not in both[1]]
            keys += rest
            yield pa.RecordBatch.from_arrays([pa.array([*keys, ""]), pa.array([*(both[1][k] for k in keys), totals[1]], pa.int64()), pa.array([*(both[0][k] for k in keys), totals[0]], pa.int64())], ["entry", "p", "n"])

    sums = picked.mapInArrow(counted, "entry string, p long, n long").groupBy("entry").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    rows = sums.where("entry = '' or (p >= 3 and p > n)").collect()  # of the bounded sample
    total = next((r for r in rows if r.entry == ""), None)
    if total is None or not total.p or not total.n:
        return plain
    words, stems = _chosen([(r.entry, r.p, r.n) for r in rows if r.entry], total.p, total.n)
    lexicon = Lexicon({**{w: 2.5 for w in seed}, **words}, stems)

    def measured(batches):
        for b in batches:
            x = [_features(t, lexicon)[0] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    got = picked.mapInArrow(measured, "y int, x array<double>").groupBy("y", "x").count().collect()
    x, y, n = np.array([r.x for r in got]), np.array([r.y for r in got], float), np.array([r["count"] for r in got], float)
    prior = np.array(PRIOR)
    w, b = prior.copy(), BIAS
    share = n / n.sum()
    for _ in range(3000):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = share * (y - p)
        w, b = w + 1.0 * (x.T @ g - 1e-4 * (w - prior)), b + 1.0 * g.sum()
    return Model(lexicon, w, b)


def toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted and the number of matched insults and threats of every row."""

    def each(batches):
        for b in batches:
            got = [model.score(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([int(s >= 0.5) for s, _ in got], pa.int32()), pa.array([n for _, n in got], pa.int32())], ["doc_id", "score", "predicted", "matches"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, SCHEMA)


def civil(documents: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is under 0.5, with all their columns."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t or "")[0] for t in texts], dtype=float)

    return documents.where(score("text") < 0.5)
