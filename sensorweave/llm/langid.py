"""Language of documents by a linear-chain conditional random field over words.

A word's evidence is the sum of learned weights of its features: the word itself (lexicon), its first
and last 2 to 4 bytes (affixes) and its byte 2- and 3-grams, all hashed into one table.  Learned
transitions link the labels of neighbouring words, so that words of code-switched text are labelled in
context; forward-backward gives each word's label distribution.  A document gets the label of the
largest mean probability over its words, and that mean as its score.

A text is cut into chains of ``CHAIN`` words, which bounds the work of one recursion step and lets
many chains run side by side; every word belongs to a chain.  Training chains are partly spliced from
two documents, so that transitions between languages are seen.

Defined results: a null text and a text without a letter are ``und`` with score 0; with no labelled
row outside the held-out fold every text is ``und``; of languages with equal means the first in order
of name is taken; of rows of the sample that share a key all are learned from.  Other columns are left
out of the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorweave.llm._flat import byte_buffer, chunks, mix, token_hashes, token_spans
from sensorweave.llm._labels import fold, held_out
from sensorweave.llm._shared import Tables, small_batches

#: Labelled rows that the model is fitted on, at most.
MAX_FIT_ROWS = 2_400
BUCKETS = 1 << 16
CHAIN = 64
#: Chains whose forward-backward is held at once while fitting, and tasks of a round of fitting.
BLOCK = 2_000
FIT_TASKS = 8
#: Training chains of about so many bytes of text share one list of distinct words.
BLOCK_BYTES = 2_000_000
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[ord("a") : ord("z") + 1] = True
_WORD_BYTE[ord("A") : ord("Z") + 1] = True
_WORD_BYTE[128:] = True
_SEEDS = np.arange(1, 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """The words of some texts: for each place the index of its distinct word; features of distinct words."""

    at: np.ndarray
    counts: np.ndarray
    #: word index and bucket of every feature
    owner: np.ndarray
    bucket: np.ndarray
    n: int


def _bucket(values: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(values.astype(np.uint64) + _SEEDS[kind]) >> np.uint64(48)).astype(np.int32)


def words_of(texts: list[str | None]) -> Words:
    buf, offsets = byte_buffer([(t or "").lower() for t in texts])
    starts, ends, counts = token_spans(_WORD_BYTE[buf], offsets)
    hashes = token_hashes(buf, starts, ends)
    distinct, first, at = np.unique(hashes, return_index=True, return_inverse=True)
    s, e = starts[first], ends[first]
    n = len(distinct)
    lengths = e - s
    owners, buckets = [np.arange(n, dtype=np.int32)], [_bucket(distinct, 0)]
    if n:
        padded = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint64)
        for k in (2, 3, 4):  # affixes
            enough = np.flatnonzero(lengths >= k)
            head = sum(padded[s[enough] + j] << np.uint64(8 * j) for j in range(k))
            tail = sum(padded[e[enough] - 1 - j] << np.uint64(8 * j) for j in range(k))
            owners += [enough.astype(np.int32)] * 2
            buckets += [_bucket(head, k), _bucket(tail, k + 4)]
        total = int(lengths.sum())
        begin = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
        place = np.repeat(s, lengths) + np.arange(total) - np.repeat(begin, lengths)
        left = np.repeat(e, lengths) - place
        for k in (2, 3):
            inside = np.flatnonzero(left >= k)
            gram = sum(padded[place[inside] + j] << np.uint64(8 * j) for j in range(k))
            owners.append(owner[inside])
            buckets.append(_bucket(gram, k + 8))
    return Words(at.astype(np.int32), counts, np.concatenate(owners), np.concatenate(buckets), n)


def _chains(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word indices by (step, chain), -1 after a chain's end; the text of each chain; place of each word."""
    per = -(-counts // CHAIN)
    text = np.repeat(np.arange(len(counts)), per)
    within = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    chain = np.repeat(np.cumsum(per) - per, counts) + within // CHAIN
    flat = within % CHAIN * len(text) + chain
    grid = np.full(CHAIN * len(text), -1, np.int32)
    grid[flat] = at
    return grid.reshape(CHAIN, len(text)), text, flat


def _marginals(evidence: np.ndarray, inside: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over (step, chain, label) evidence in logs: label distributions, pair counts, chain log sums."""
    steps, n, _ = evidence.shape
    peak = evidence.max(2, keepdims=True)
    e = np.exp(evidence - peak)
    a, p = np.exp(move), np.exp(start)
    alpha, norm = np.empty_like(e), np.ones((steps, n))
    for t in range(steps):
        v = e[t] * (p if t == 0 else alpha[t - 1] @ a)
        s = v.sum(1)
        v = v / s[:, None]
        if t:
            v = np.where(inside[t][:, None], v, alpha[t - 1])
            s = np.where(inside[t], s, 1.0)
        alpha[t], norm[t] = v, s
    beta = np.ones_like(e)
    pairs = np.zeros_like(a)
    for t in range(steps - 1, 0, -1):
        w = e[t] * beta[t] / norm[t][:, None]
        w = np.where(inside[t][:, None], w, 0.0)
        pairs += alpha[t - 1].T @ w
        beta[t - 1] = np.where(inside[t][:, None], w @ a.T, beta[t])
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(2, keepdims=True), 1e-300)
    total = np.log(norm).sum(0) + np.where(inside, peak[:, :, 0], 0).sum(0)
    return gamma, pairs * a, total


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray
    start: np.ndarray
    move: np.ndarray

    def evidence(self, words: Words) -> np.ndarray:
        out = np.empty((words.n, len(self.labels)), np.float64)
        for k in range(len(self.labels)):
            out[:, k] = np.bincount(words.owner, self.weights[words.bucket, k], words.n)
        return out

    def word_marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Label distributions of all words, text after text, and the number of words by text."""
        words = words_of(texts)
        if not len(words.at):
            return np.zeros((0, len(self.labels))), words.counts
        grid, _, flat = _chains(words.at, words.counts)
        inside = grid >= 0
        gamma, _, _ = _marginals(self.evidence(words)[np.maximum(grid, 0)], inside, self.start, self.move)
        return gamma.reshape(-1, len(self.labels))[flat], words.counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.labels:
            return names, scores
        for a, b in chunks(texts):
            gamma, counts = self.word_marginals(texts[a:b])
            full = np.flatnonzero(counts)
            if not len(full):
                continue
            mean = np.add.reduceat(gamma, (np.cumsum(counts) - counts)[full], axis=0) / counts[full][:, None]
            for i, row in zip(full.tolist(), mean, strict=True):
                if _LETTER.search(texts[a + i]):
                    k = int(row.argmax())
                    names[a + i], scores[a + i] = self.labels[k], min(1.0, float(row[k]))
        return names, scores


def _sample(documents: DataFrame, key: str, text: str, lang: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows outside the held-out fold, the languages in equal shares as far as they go; one row, of the least text, for a repeated key."""
    known = documents.where(F.col(key).isNotNull() & F.col(lang).isNotNull() & (fold(key, 4) != 2))
    sizes = {r[lang]: r["n"] for r in known.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    share = max_rows / max(1, len(sizes))
    # a second hash parts keys of one millionth, so that a share of less than a millionth still holds rows
    place = F.abs(F.xxhash64(F.col(key)) % 1_000_000) + F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit("part")), 11) / float(1 << 53)
    within = F.lit(False)
    for name, n in sorted(sizes.items()):
        within = within | ((F.col(lang) == name) & (place < 1_000_000 * min(1.0, share / n)))
    chosen = known.select(F.col(key)).where(within if sizes else F.lit(False))
    chosen = known.where(within).select(key) if sizes else chosen
    chosen = chosen.distinct().orderBy(F.xxhash64(key), key).limit(max_rows)
    found = known.select(key, F.coalesce(text, F.lit("")).alias("text"), F.col(lang).alias("lang")).join(F.broadcast(chosen), key)
    found = found.groupBy(key).agg(F.min(F.struct("text", "lang")).alias("row")).select(key, "row.text", "row.lang")
    return found.repartition(FIT_TASKS, F.xxhash64(key)).persist(StorageLevel.MEMORY_AND_DISK)


def _blocks(sample: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """The training chains of the sample, a row for each chunk of texts: word and label by (step, chain), and the words' features.

    Two of five chains go over, at a random step, into another chain of the chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in chunks(texts, BLOCK_BYTES):
                words = words_of(texts[a:b])
                if not len(words.at):
                    continue
                grid, text_of, _ = _chains(words.at, words.counts)
                truth = np.array([labels.index(x) for x in langs[a:b]], np.int32)[text_of]
                rng, n = np.random.default_rng(0), grid.shape[1]
                other, cut = rng.permutation(n), np.where(rng.random(n) < 0.4, rng.integers(1, CHAIN, n), CHAIN)
                late = np.arange(CHAIN)[:, None] >= cut
                grid, truth = np.where(late, grid[:, other], grid), np.where(late, truth[other], truth)
                grid = np.where(np.logical_and.accumulate(grid >= 0, axis=0), grid, -1)
                kinds = np.int32, np.int16, np.int32, np.uint16
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip((grid, truth, words.owner, words.bucket), kinds, strict=True)], names=["grid", "truth", "owner", "bucket"])

    rows = sample.sortWithinPartitions(F.xxhash64(key), "text", "lang").select("text", "lang")
    return rows.mapInArrow(run, "grid binary, truth binary, owner binary, bucket binary")


def _slopes(blocks: DataFrame, model: LanguageModel) -> tuple[list[np.ndarray], int, int]:
    """Sums over all chains of expected less true counts (by bucket and label, first label, label pair); chains and words.

    A task sums its blocks and gives the buckets that occur, so what comes to the driver is bounded by
    ``FIT_TASKS`` tables of ``BUCKETS`` rows, whatever the length of the texts.
    """
    size = len(model.labels)
    sent = LanguageModel(model.labels, model.weights.astype(np.float32), model.start.copy(), model.move.copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start, move, n, total, hot = np.zeros((BUCKETS, size)), np.zeros(size), np.zeros((size, size)), 0, 0, np.eye(size)
        kinds = np.int32, np.int16, np.int32, np.uint16
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("grid", "truth", "owner", "bucket")), strict=True):
                grid, truth, owner, bucket = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, kinds, strict=True))
                grid, truth = grid.reshape(CHAIN, -1), truth.reshape(CHAIN, -1)
                words = Words(grid, grid, owner, bucket, int(owner.max()) + 1)
                evidence, by_word = sent.evidence(words), np.zeros((words.n, size))
                for at in range(0, grid.shape[1], BLOCK):
                    own, y = grid[:, at : at + BLOCK], truth[:, at : at + BLOCK]
                    inside, own = own >= 0, np.maximum(own, 0)
                    gamma, pairs, _ = _marginals(evidence[own], inside, sent.start, sent.move)
                    wrong = ((gamma - hot[y]) * inside[:, :, None]).reshape(-1, size)
                    by_word += np.column_stack([np.bincount(own.ravel(), wrong[:, k], words.n) for k in range(size)])
                    start += gamma[0].sum(0) - np.bincount(y[0], minlength=size)
                    move += pairs - np.bincount((y[:-1] * size + y[1:])[inside[1:]], minlength=size * size).reshape(size, size)
                    n, total = n + own.shape[1], total + int(inside.sum())
                weights += np.column_stack([np.bincount(bucket, by_word[owner, k], BUCKETS) for k in range(size)])
        at = np.flatnonzero(weights.any(1))
        sums = [pa.array([x.tobytes()], pa.binary()) for x in (at, weights[at].astype(np.float32), start, move)]
        yield pa.RecordBatch.from_arrays([*sums, pa.array([n]), pa.array([total])], names=["at", "weights", "start", "move", "n", "total"])

    sums, n, total = [np.zeros_like(v) for v in (model.weights, model.start, model.move)], 0, 0
    found = blocks.mapInArrow(run, "at binary, weights binary, start binary, move binary, n long, total long").toArrow()
    for *parts, some, words in zip(*found.columns, strict=True):
        at, weights, start, move = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(parts, (np.int64, np.float32, float, float), strict=True))
        sums[0][at] += weights.reshape(-1, size)
        sums[1] += start
        sums[2] += move.reshape(size, size)
        n, total = n + some.as_py(), total + words.as_py()
    return sums, n, total


def fit_language(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_FIT_ROWS, rounds: int = 30) -> LanguageModel:
    """Fits weights and transitions by the chains' conditional likelihood (Adam) on a bounded sample of rows.

    All chains of the sampled texts are learned from.  They are made once and stored in the shared
    folder; each round sums their slopes in tasks, so no text and no chain comes to the driver.
    """
    tables = Tables(documents.sparkSession, "language-fit")
    sample = _sample(documents, key, text, lang, max_rows)
    try:
        labels = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
        blocks = tables.add(_blocks(sample, key, labels))
        kept = blocks.coalesce(FIT_TASKS).persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        sample.unpersist()
    size = len(labels)
    model = LanguageModel(labels, np.zeros((BUCKETS, size)), np.zeros(size), np.full((size, size), -2.0) + 2 * np.eye(size))
    values = model.weights, model.start, model.move
    mean, square = ([np.zeros_like(v) for v in values] for _ in range(2))
    for step in range(1, rounds + 1):
        sums, n, total = _slopes(kept, model) if labels else (None, 0, 0)
        if not total:
            model.labels = []
            break
        slopes = sums[0] / total + 1e-7 * model.weights, sums[1] / n, sums[2] / total
        for i, (value, slope) in enumerate(zip(values, slopes, strict=True)):
            mean[i] = 0.9 * mean[i] + 0.1 * slope
            square[i] = 0.99 * square[i] + 0.01 * slope**2
            value -= 0.1 * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-9)
    kept.unpersist()
    tables.keep_only()
    model.weights = model.weights.astype(np.float32)
    return model


def identify(documents: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, held_out, lang_pred and score of every document; one pass, no shuffle."""
    small_batches(documents.sparkSession)
    df = documents.select(F.col(key), F.col(text), held_out(key, 4, 2).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[key, "held_out", "lang_pred", "score"])

    return df.mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(documents: DataFrame, model: LanguageModel, text: str = "text", min_score: float = 0.3) -> DataFrame:
    """The rows whose text has a language of at least ``min_score``, with all their columns; without a fitted language, all rows."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = model.predict(batch.column(text).to_pylist())
            keep = [not model.labels or (n != UNKNOWN and s >= min_score) for n, s in zip(names, scores, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
