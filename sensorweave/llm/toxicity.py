"""Toxicity by a weighted lexicon.

Texts are folded (case, accents, homoglyphs, digits that stand for letters) and matched against the
lexicon and its exception phrases by one Aho-Corasick automaton.  The weights of the terms found, less
those inside an exception phrase, are taken as a sum and by length; a logistic curve over both gives
the score.

The lexicon is learned: words whose document counts differ by label beyond chance, taken greedily,
each from the documents that no earlier word explains, so that words that merely come along with a
term (in copies of one document, say) do not enter.

Defined results: a null or empty text has no terms and gets the score of such texts; a text of any
length is read whole; a text without a word is as short as one word.  Other columns are left out of
the result, whatever their names.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorweave.llm._labels import held_out, labelled_sample
from sensorweave.llm._shared import small_batches

#: Letters of other alphabets, and digits and signs, that pass for Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ь": "b",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "b", "æ": "a", "ɡ": "g", "ⅼ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l",
}
#: Phrases in which words of the lexicon are not toxic, unless ``fit_lexicon`` is given others.
EXCEPTIONS = ("clown fish", "clown car", "trash can", "trash bin", "pathetic fallacy", "idiot proof", "pond scum", "sore loser rule", "stupid simple")

#: Labelled rows that a lexicon is learned from, at most.
MAX_FIT_ROWS = 20_000

_ZERO_WIDTH = "­​‌‍⁠﻿"
_WORD = re.compile(r"[^\W_]+")


def _fold_table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        base = unicodedata.normalize("NFKD", chr(code)).casefold()
        if base and base[0].isascii() and base[0].isalnum() and (len(base) == 1 or all(unicodedata.combining(c) for c in base[1:])):
            table[code] = base[0]
    for code in range(0x300, 0x370):
        table[code] = None
    table |= {ord(c): None for c in _ZERO_WIDTH}
    table |= {ord(k): v for k, v in HOMOGLYPHS.items()}
    table |= {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    # l, I and 1 look alike: one letter stands for all three, in texts and in the lexicon
    return {k: v.translate({ord("l"): "i"}) if v else v for k, v in table.items()} | {ord("l"): "i", ord("L"): "i", ord("|"): " "}


_FOLD = _fold_table()


def fold_text(text: str | None) -> str:
    """The skeleton of a text: what it looks like, in lower-case Latin letters."""
    return (text or "").lower().translate(_FOLD)


@dataclass
class Lexicon:
    """Weights of folded terms, folded exception phrases, and the curve from sums to scores."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = tuple(fold_text(x) for x in EXCEPTIONS)
    #: intercept, weight of log(1 + sum), weight of log(1 + sum by length)
    curve: tuple[float, float, float] = (-4.0, 3.0, 0.0)
    _automaton: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_automaton": []}

    def automaton(self) -> ahocorasick.Automaton:
        if not self._automaton:
            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                found.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                found.add_word(phrase, (len(phrase), None))
            if len(found):
                found.make_automaton()
            self._automaton.append(found)
        return self._automaton[0]

    def spans(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the terms that stand as whole words outside exception phrases."""
        automaton = self.automaton()
        terms, excused = [], []
        for end, (n, weight) in automaton.iter(folded) if len(automaton) else ():
            start, end = end - n + 1, end + 1
            if (start and folded[start - 1].isalnum()) or (end < len(folded) and folded[end].isalnum()):
                continue
            (excused if weight is None else terms).append((start, end, weight))
        if excused and terms:
            terms = [t for t in terms if not any(a <= t[0] and t[1] <= b for a, b, _ in excused)]
        return terms

    def measure(self, text: str | None) -> tuple[float, int, int]:
        """Sum of weights, number of terms, length in words' worth of six characters."""
        folded = fold_text(text)
        spans = self.spans(folded)
        return sum(w for _, _, w in spans), len(spans), max(1, len(folded) // 6)

    def scores(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(total) + c * np.log1p(1000 * total / words), -40, 40)))


def _log_tail(hits: int, trials: int, rate: float) -> float:
    """A bound of the log of the chance of so many hits among trials."""
    p = hits / trials
    if p <= rate:
        return 0.0
    other = (1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0.0
    return -trials * (p * math.log(p / rate) + other)


def _word_counts(sample: DataFrame, label: str) -> DataFrame:
    """By folded word: the distinct neighbourhoods it has in documents of label 1, and documents of label 0.

    Copies of one document share their neighbourhoods, so many copies count as one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros: Counter = Counter()
        places: set[tuple[str, int]] = set()
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column(label).to_pylist(), strict=True):
                words = _WORD.findall(fold_text(text))
                if y:
                    for before, word, after in zip(["", *words], words, [*words[1:], ""], strict=False):
                        places.add((word, zlib.crc32(f"{before} {after}".encode())))
                else:
                    zeros.update(set(words))
        words = [w for w, _ in places] + list(zeros)
        at = pa.array([c for _, c in places] + [None] * len(zeros), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), at, pa.array([0] * len(places) + list(zeros.values()), pa.int64())], names=["word", "place", "zeros"])

    rows = sample.select("text", label).mapInArrow(run, "word string, place long, zeros long").groupBy("word", "place").agg(F.sum("zeros").alias("zeros"))
    return rows.groupBy("word").agg(F.count("place").alias("ones"), F.sum("zeros").alias("zeros"))


def _incidence(sample: DataFrame, label: str, terms: list[str]) -> list:
    """(label, length in words, candidate terms with their counts and first neighbourhoods) of each document of the sample."""
    lexicon = Lexicon({t: float(i) for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, found, times, places = [], [], [], []
            for text in batch.column("text").to_pylist():
                folded = fold_text(text)
                spans = lexicon.spans(folded)
                seen = Counter(int(w) for _, _, w in spans)
                near = {int(w): zlib.crc32(folded[max(0, a - 12) : b + 12].encode()) for a, b, w in reversed(spans)}
                lengths.append(max(1, len(folded) // 6))
                found.append(list(seen))
                times.append(list(seen.values()))
                places.append([near[t] for t in seen])
            yield pa.RecordBatch.from_arrays([batch.column(label), pa.array(lengths, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int64()))], names=["y", "n", "terms", "times", "places"])

    return sample.select(label, "text").mapInArrow(run, "y int, n long, terms array<int>, times array<int>, places array<long>").collect()


def fit_lexicon(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_FIT_ROWS, exceptions: Iterable[str] = EXCEPTIONS) -> Lexicon:
    """Learns terms, weights and curve from at most ``max_rows`` labelled rows outside the held-out fold.

    Candidates are the words of three letters or more that stand in at least four places of documents of
    label 1 and more often there than not; the bound on the rows bounds them.

    Without labelled rows of both kinds the lexicon is empty and every score is low.
    """
    small_batches(documents.sparkSession)
    exceptions = tuple(fold_text(x) for x in exceptions)
    sample = labelled_sample(documents, labels, label, max_rows)
    try:
        sizes = sample.agg(F.count("*").alias("n"), F.sum(label).alias("ones")).first()
        n, ones = sizes["n"], sizes["ones"] or 0
        if not 0 < ones < n:
            return Lexicon({}, exceptions)
        rate = ones / n
        counts = _word_counts(sample, label).where("ones + zeros >= 4").persist()
        vocabulary = counts.count()
        both = F.col("ones") + F.col("zeros")
        lift = F.col("ones") * F.log(F.col("ones") / both / F.lit(rate))
        rows = counts.where((F.col("ones") >= 4) & (F.col("ones") > F.lit(0.5) * both) & (F.length("word") >= 3)).orderBy(lift.desc(), "word").collect()
        counts.unpersist()
        terms = [r["word"] for r in rows]
        docs = _incidence(sample, label, terms)
    finally:
        sample.unpersist()
    y = np.array([d["y"] for d in docs], np.int64)
    by_term: dict[int, list[tuple[int, int]]] = {}
    for i, d in enumerate(docs):
        for t, place in zip(d["terms"], d["places"], strict=True):
            by_term.setdefault(t, []).append((i, place))
    left = np.ones(len(y), bool)
    chosen: dict[int, float] = {}
    bar = math.log(0.1 / max(vocabulary, 1))
    while True:
        base = min(0.99, max(1e-3, y[left].mean())) if left.any() else 0.5
        best = (bar, None, 0, 0)
        for t, at in by_term.items():
            if t in chosen:
                continue
            hits = len({place for i, place in at if left[i] and y[i]})
            misses = sum(1 for i, _ in at if left[i] and not y[i])
            if hits >= 4 and hits >= 1.5 * misses and (chance := _log_tail(hits, hits + misses, base)) < best[0]:
                best = (chance, t, hits, misses)
        _, t, hits, misses = best
        if t is None:
            break
        chosen[t] = math.log((hits + 0.5) / (misses + 0.5)) - math.log(base / (1 - base))
        left[[i for i, _ in by_term[t]]] = False
    weights = {terms[t]: max(0.1, w) for t, w in chosen.items()}
    total = np.array([sum(chosen.get(t, 0.0) * k for t, k in zip(d["terms"], d["times"], strict=True)) for d in docs])
    return Lexicon(weights, exceptions, _curve(total, np.array([d["n"] for d in docs]), y))


def _curve(total: np.ndarray, words: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(y)), np.log1p(total), np.log1p(1000 * total / words)])
    w, ridge = np.zeros(3), np.diag([1e-6, 0.5, 0.5])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def score(documents: DataFrame, lexicon: Lexicon, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Key, held_out, score, predicted and the number of terms of every document; one pass, no shuffle."""
    small_batches(documents.sparkSession)
    df = documents.select(F.col(key), F.col(text), held_out(key, 5, 0).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.measure(t) for t in batch.column(text).to_pylist()]
            total, terms, words = (np.array(x) for x in zip(*found, strict=True)) if found else (np.zeros(0), np.zeros(0, int), np.ones(0))
            scores = lexicon.scores(total.astype(float), words)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), pa.array(terms.astype(np.int64))],
                names=[key, "held_out", "score", "predicted", "n_terms"],
            )

    return df.mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int, n_terms long")
