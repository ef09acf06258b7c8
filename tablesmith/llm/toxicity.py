"""Toxicity by a weighted finite-state pattern grammar over clauses.

A first transducer reads characters: tries of insults, threats, targets,
negations and reporting verbs turn a word into a class and a weight; the words
and word stems of the insult trie, and their weights, come from labelled texts
beside a short list of common ones. Four small transducers over classes
(insult or threat with its target, negation, reported speech, repetition) are
composed into one machine, which reads every clause that holds an insult or
threat and gives it a weight, apart for what words and what stems bear. A
text's evidence is the sum of its clauses' weights; a logistic curve over both
sums and the density of the second, fitted on labelled texts whose terms come
from others, makes it a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample

#: Labelled clean and toxic documents in the training sample, at most.
TRAIN_PER_CLASS = (5000, 3000)
#: How much commoner a learned word or stem must be in toxic texts, and the chance that any one of them is learned by accident.
MIN_LOG_ODDS, ERROR_RATE = 2.5, 0.02
STEMS = (4, 5, 6, 7)
#: Characters over which the density of stems is taken.
CHARS = 200
#: Parts of the sample; the curve sees each with the terms of the others.
FOLDS = 3

# Common words of each class in four languages.
INSULTS = "idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown imbecile fool idiota estupido basura idiote imbecile stupide dumm idiotin abschaum".split()
THREATS = "kill hurt destroy strangle stab murder matar tuer umbringen".split()
TARGETS = "you your yours u he she they him her them du dich dir ihr euch tu toi te vous usted ustedes".split()
NEGATIONS = "not no never neither nor isn't aren't wasn't nicht kein keine nie ne pas jamais nunca jamas".split()
REPORTS = "said says say told called quoted wrote reported claims sagte sagt dit disait dijo dice".split()

CLASSES = "oitgnr"  # other, insult, threat, target, negation, report
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n|]")


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    curve: tuple[float, ...]


#: Transducers over classes: state -> class -> (state, factor on the pending weight). Missing: stay, 1.
TARGETED = {0: {"g": (1, 1.0)}, 1: {"g": (1, 1.0), "i": (1, 1.3), "t": (1, 1.6)}}
NEGATED = {0: {"n": (1, 1.0)}, 1: {"n": (1, 1.0), "i": (0, 0.5), "t": (0, 0.5), "o": (2, 1.0)}, 2: {"n": (1, 1.0), "i": (0, 0.6), "t": (0, 0.6), "o": (0, 1.0)}}
REPORTED = {0: {"r": (1, 1.0)}, 1: {"i": (1, 0.6), "t": (1, 0.6)}}
REPEATED = {0: {"i": (1, 1.0), "t": (1, 1.0)}, 1: {"i": (1, 1.2), "t": (1, 1.2)}}


def compose(*machines: dict) -> dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], float]]:
    """The product machine: states step together, factors multiply."""
    out = {}
    for state in product(*machines):
        for c in CLASSES:
            steps = [m[s].get(c, (s, 1.0)) for m, s in zip(machines, state, strict=True)]
            out[state, c] = tuple(s for s, _ in steps), math.prod(f for _, f in steps)
    return out


GRAMMAR = compose(TARGETED, NEGATED, REPORTED, REPEATED)
START = (0, 0, 0, 0)


class Reader:
    """The character transducers and the grammar, for one process."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        import ahocorasick

        self.words = {w: ("i", x) for w, x in words.items()} | {w: ("t", 1.5) for w in THREATS}
        self.stems, self.lengths = stems, sorted({len(s) for s in stems}, reverse=True)
        for c, some in (("g", TARGETS), ("n", NEGATIONS), ("r", REPORTS)):
            self.words |= {w: (c, 0.0) for w in some if w not in self.words}
        self.find = ahocorasick.Automaton()
        for w in {*words, *THREATS, *stems}:
            self.find.add_word(w, len(w))
        if len(self.find):
            self.find.make_automaton()

    def read(self, word: str) -> tuple[str, float, int]:
        """Class, weight, and whether a stem bears it."""
        got = self.words.get(word)
        if got is None:
            for n in self.lengths:
                if len(word) >= n and (x := self.stems.get(word[:n])) is not None:
                    return "i", x, 1
            return "o", 0.0, 0
        return *got, 0

    def clause(self, text: str) -> list[float]:
        state, total = START, [0.0, 0.0]
        for m in WORD.finditer(text):
            c, x, stem = self.read(m[0])
            state, factor = GRAMMAR[state, c]
            total[stem] += x * factor
        return total

    def evidence(self, text: str | None) -> tuple[float, float]:
        """The sums of the clauses' weights by words and by stems, by half for what a clause adds beyond 6."""
        total, upto = [0.0, 0.0], 0
        if not text or not len(self.find):
            return 0.0, 0.0
        low = text.lower()
        for end, n in self.find.iter(low):
            at = end - n + 1
            if at < upto or at and low[at - 1].isalpha():
                continue
            left = max((low.rfind(c, upto, at) for c in ".!?;:\n|"), default=-1) + 1
            stop = CLAUSE_END.search(low, end)
            right = stop.start() if stop else len(low)
            for k, w in enumerate(self.clause(low[max(left, upto) : right])):
                total[k] += min(w, 6.0) + max(w - 6.0, 0.0) / 2
            upto = right
        return total[0], total[1]

    def features(self, text: str | None) -> tuple[float, float, float]:
        words, stems = self.evidence(text)
        return math.log1p(words), math.log1p(stems), math.log1p(CHARS * stems / (len(text or "") + CHARS))


def without_copies(texts: list[str], slots: int = 8, same: int = 3) -> list[str]:
    """The texts less those that share ``same`` of their least shingle hashes with an earlier one: a copied text is evidence once."""
    import xxhash

    seen, out = set(), []
    for t in texts:
        words = WORD.findall(t.lower())
        grams = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
        hashes = np.array([xxhash.xxh64_intdigest(g) for g in grams], np.uint64)
        own = [(k, int((hashes * np.uint64(2 * k + 1) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min())) for k in range(slots)]
        if sum(x in seen for x in own) < same:
            out.append(t)
        seen.update(own)
    return out


def word_set(text: str) -> frozenset[str]:
    return frozenset(WORD.findall(text.lower()))


def induce(toxic: list[frozenset[str]], clean: list[frozenset[str]]) -> tuple[dict[str, float], dict[str, float]]:
    """From the word sets of texts: words and stems that mark toxic texts, with weights: smoothed log odds, shrunk to (0, 3].

    A word counts by the texts that have it, a stem by the distinct words that
    bear it, summed over the texts. A term is kept only if its share of toxic
    texts (or of their words) is beyond what chance gives any of the terms
    tried: a bound on the binomial tail against ERROR_RATE.
    """
    own = [toxic, clean]

    def marks(sides: list[Counter], n1: float, n0: float) -> dict[str, float]:
        share, out, most = n1 / (n1 + n0), {}, math.log(ERROR_RATE / max(1, len(sides[0])))
        for w, a in sides[0].items():
            b = sides[1][w]
            odds, q = math.log((a + 0.25) / n1) - math.log((b + 0.25) / n0), a / (a + b)
            if odds < MIN_LOG_ODDS or q <= share:
                continue
            # Chernoff's bound on the log chance of a or more of a + b being toxic.
            tail = -(a + b) * (q * math.log(q / share) + (1 - q) * math.log((1 - q) / (1 - share)) if q < 1 else math.log(1 / share))
            if tail <= most:
                out[w] = min(3.0, 0.6 * odds)
        return out

    words = marks([Counter(w for t in side for w in t) for side in own], len(toxic) + 1, len(clean) + 1)
    borne = [Counter(w[:n] for t in side for w in t for n in STEMS if len(w) > n) for side in own]
    stems = marks(borne, *(sum(map(len, side)) + 1 for side in own))
    texts = Counter(s for t in own[0] for s in {w[:n] for w in t for n in STEMS if len(w) > n} if s in stems)
    kinds = Counter(w[:n] for w in set().union(*own[0]) for n in STEMS if len(w) > n)
    return words, {s: x for s, x in stems.items() if texts[s] >= 3 and kinds[s] >= 3}


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[float, ...]:
    """Offset and slopes (none below zero) by Newton steps; both classes weigh the same."""
    k = x.shape[1] if x.ndim == 2 else 0
    if not len(y) or y.min() == y.max():
        return float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0, *[0.0] * (k or 3)
    w = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    used = list(range(k))
    while True:
        a = np.concatenate([np.ones((len(y), 1)), x[:, used]], axis=1)
        pull, b = ridge * np.array([1e-3] + [1.0] * len(used)) * len(y) / 100, np.zeros(1 + len(used))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9), a.T @ (w * (y - p)) - pull * b)
            b += step
            if np.abs(step).max() < 1e-8:
                break
        low = [i for i, s in zip(used, b[1:], strict=True) if s < 0]
        if not low:
            slopes = dict(zip(used, b[1:], strict=True))
            return float(b[0]), *(float(slopes.get(i, 0.0)) for i in range(k))
        used = [i for i in used if i not in low]


def learn(rows: list[tuple[int, int, str]]) -> Model:
    """From (label, number that deals out the folds, text)."""
    x, y, fold = [], [], {t: u % FOLDS for _, u, t in rows}
    parts = [[(fold[t], word_set(t)) for t in without_copies([t for c, _, t in rows if c == k])] for k in (1, 0)]
    for k in range(FOLDS):
        words, stems = induce(*([ws for f, ws in part if f != k] for part in parts))
        reader = Reader({w: 1.5 for w in INSULTS} | words, stems)
        own = [(reader.features(t), c) for c, u, t in rows if u % FOLDS == k]
        x += [f for f, _ in own]
        y += [c for _, c in own]
    words, stems = induce(*([ws for _, ws in part] for part in parts))
    return Model({w: 1.5 for w in INSULTS} | words, stems, fit_curve(np.array(x, float).reshape(-1, 3), np.array(y, int)))


def train(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = TRAIN_PER_CLASS) -> Model:
    """labels: doc_id, toxic, of rows that may be learned from.

    Rows without an id or a label of 0 or 1 are not drawn; a null text counts
    as empty, and of rows that share an id one is drawn. Without labels of both
    classes the score is the share of the one there is; other columns are not read.
    """
    return learn(sorted((r["y"], r["u"], r["text"]) for r in labelled_sample(docs, labels, "toxic", per_class).collect()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, score (0 to 1), predicted (score of 0.7 or more).

    Null and empty texts have no clause and get the curve's value at zero.
    Repeated rows give repeated rows, an empty table an empty result; other
    columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        reader = Reader(m.words, m.stems)
        for b in batches:
            x = np.array([reader.features(t.as_py()) for t in b.column(1)], float).reshape(-1, 3)
            p = 1 / (1 + np.exp(-np.clip(x @ np.array(m.curve[1:]) + m.curve[0], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.7).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
