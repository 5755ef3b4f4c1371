"""Exact token counts at every prefix of a text, by dynamic programming over prefixes.

For a byte-level BPE vocabulary the encoding of a prefix ends in exactly one token that fits: a token
fits after another if merging their bytes never crosses the border between them, and a row of tokens of
which each neighbouring two fit is the encoding of its bytes.  So the last token of every prefix follows
from the last tokens of shorter prefixes, and with it the prefix's count, in one pass and without
encoding any prefix by itself.  Stored counts answer how many tokens a prefix has, which is the longest
prefix within a budget and where windows of a budget end, without encoding again.

Counts are those of the text up to each character as if it ended there: blanks that end a prefix are one
run, although more text would give the last of them to the next word, and a special string counts as one
token once it is complete.  A count can therefore be lower than that of a shorter prefix.

Defined results: a null text is the empty text (no counts, 0 tokens); a text of any length is counted
whole, in blocks that end before a blank; rows are independent, so repeated rows and null or equal ids
give a row each; other columns of the input do not matter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorweave.llm._shared import small_batches

#: The rule that splits a text before merging, as the vocabulary's library publishes it, with letters and
#: digits as ``re`` names them; characters that the library takes otherwise are replaced before.
SPLIT = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
BLANKS = re.compile(r"\s{2,}(?=\S)")
BLOCK_END = re.compile(r"(?<=\S)(?=\s)")
#: Characters of each class that no other rule names.
LETTER, DIGIT, BLANK, OTHER = "b", "0", "\t", "!"
#: Pieces whose counts a worker remembers, and the characters of the longest one.
CACHE_PIECES, CACHE_LEN = 400_000, 40
#: Characters after which a text's block ends at the next blank.
BLOCK_CHARS = 200_000

COUNT = np.dtype("<i4")


def _byte_of_letter() -> dict[str, int]:
    """The byte behind each letter of a vocabulary file: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _read_as(splitter) -> dict[str, str]:
    """Asks the library for the class of each character that may be a letter, digit or blank, and keeps those that ``re`` takes otherwise."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    asked = [c for c in every if c.isalnum() or c.isspace() or unicodedata.category(c)[0] in "LNZC" and ord(c) < 0x3400 or c == "_"]
    found = {}
    for at in range(0, len(asked), 500):
        some = asked[at : at + 500]
        letters, digits, others = ({begin for _, (begin, end) in splitter.pre_tokenize_str("\t\t".join(f"{x}{c}" for c in some)) if end - begin == 2} for x in (LETTER, DIGIT, OTHER))
        for i, c in enumerate(some):
            found[c] = LETTER if 4 * i in letters else DIGIT if 4 * i in digits else OTHER if 4 * i in others else BLANK

    def by_re(c: str) -> str:
        return BLANK if re.match(r"\s", c) else OTHER if re.match(r"[^\s\w]|_", c) else DIGIT if re.match(r"\d", c) else LETTER

    return {c: kind for c, kind in found.items() if kind != by_re(c)}


@dataclass
class ByteVocabulary:
    """Merges and special strings of a byte-level BPE vocabulary, as plain data that ships to executors."""

    #: the two tokens that make each merged token, in order of rank; tokens 0 to 255 are the bytes
    merges: list[tuple[int, int]]
    specials: list[str]
    #: characters that the library takes for another class than ``re`` does, with one of the right class
    read_as: dict[str, str] = field(default_factory=dict)
    _ready: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": {}}

    @classmethod
    def load(cls, path: str) -> "ByteVocabulary":
        """Reads a vocabulary file; files of another kind than this class handles are refused."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError(f"{path} has options that are not handled")
        added = spec["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError(f"{path} has special strings that are not handled")
        number = {letter: b for letter, b in _byte_of_letter().items()}
        merges = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            merges.append((number[left], number[right]))
            if number.setdefault(left + right, 255 + len(merges)) != 255 + len(merges):
                raise ValueError(f"{path} makes a token by two merges")
        return cls(merges, [t["content"] for t in added], _read_as(Tokenizer.from_str(text).pre_tokenizer))

    def ready(self) -> "_Counter":
        """The counter made from these data, once a process."""
        if "counter" not in self._ready:
            self._ready["counter"] = _Counter(self)
        return self._ready["counter"]


class _Counter:
    """Prefix counts by one vocabulary; remembers those of short units and pieces."""

    def __init__(self, vocabulary: ByteVocabulary):
        merges = vocabulary.merges
        self.parts = [(-1, -1)] * 256 + merges
        self.merged = {pair: 256 + i for i, pair in enumerate(merges)}
        spelled = [bytes([b]) for b in range(256)]
        for left, right in merges:
            spelled.append(spelled[left] + spelled[right])
        self.lengths = [len(s) for s in spelled]
        # a tree over the tokens read from their ends, for all tokens that end at a place
        self.step: dict[int, int] = {}
        self.token_at = [-1]
        for token, s in enumerate(spelled):
            if not self._makes_itself(token):
                continue
            node = 0
            for b in reversed(s):
                node = self.step.setdefault(node << 8 | b, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
            self.token_at[node] = token
        self.fits: dict[int, bool] = {}
        self.table = {ord(c): kind for c, kind in vocabulary.read_as.items()}
        self.unlike = np.zeros(0x110000, bool)
        self.unlike[list(self.table)] = True
        self.special = re.compile("|".join(map(re.escape, vocabulary.specials))) if vocabulary.specials else None
        self.known: dict[str, bytes] = {}

    def _crosses(self, left: int, right: int, but: int = -1) -> bool:
        """True if a merge other than ``but`` joins the end of ``left`` to the start of ``right`` while both are being merged.

        A merge's parts always have lower ranks than itself, so merging goes up the ranks.  The tokens at
        the end of ``left`` live until the rank that takes them into the next; a merge across the border
        happens if its rank comes before that, or, for the right side, at the same rank, as the place
        further left goes first.
        """
        ends, a, until = [], left, len(self.parts)
        while a >= 0:
            ends.append((a, until))
            until, a = a, self.parts[a][1]
        b, until_b = right, len(self.parts)
        while b >= 0:
            for a, until in ends:
                joint = self.merged.get((a, b), -1)
                if joint >= 0 and joint != but and joint < until and joint <= until_b:
                    return True
            until_b, b = b, self.parts[b][0]
        return False

    def _makes_itself(self, token: int) -> bool:
        """True if the token's own bytes are merged to it."""
        left, right = self.parts[token]
        return left < 0 or not self._crosses(left, right, token)

    def _piece(self, piece: str) -> np.ndarray:
        """Counts at the prefixes of a piece, one for each character."""
        data = piece.encode("utf-8", "surrogatepass")
        n = len(data)
        last, counts = [0] * (n + 1), [0] * (n + 1)
        step, token_at, fits = self.step, self.token_at, self.fits
        for end in range(1, n + 1):
            node, at = 0, end
            while True:
                at -= 1
                node = step[node << 8 | data[at]]
                token = token_at[node]
                if token >= 0:
                    if at == 0:
                        break
                    pair = last[at] << 20 | token
                    good = fits.get(pair)
                    if good is None:
                        good = fits[pair] = not self._crosses(last[at], token)
                    if good:
                        break
            last[end], counts[end] = token, counts[at] + 1
        if len(fits) > 2_000_000:
            fits.clear()
        found = np.array(counts, COUNT)
        if n == len(piece):
            return found[1:]
        starts = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        return found[np.append(starts[1:], n)]

    def _counts_of(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = self._piece(piece)
            if piece in ("'re", "'ve", "'ll"):
                found[1] = 2  # cut there, its quote and its letter are two pieces
            found = found.tobytes()
            if len(piece) <= CACHE_LEN:
                if len(self.known) >= CACHE_PIECES:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _block(self, text: str) -> np.ndarray:
        """Counts at the prefixes of a text without special strings."""
        odd = self.unlike[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any()
        shape = text.translate(self.table) if odd else text
        pieces = SPLIT.findall(shape)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        if shape is not text:
            pieces = [text[end - n : end] for end, n in zip(ends.tolist(), lengths.tolist())]
        out = np.frombuffer(b"".join(map(self._counts_of, pieces)), COUNT).copy()
        bases = np.zeros(len(pieces), COUNT)
        np.cumsum(out[ends[:-1] - 1], out=bases[1:])
        out += np.repeat(bases, lengths)
        for m in BLANKS.finditer(shape):  # a text that ends in such blanks has them in one piece
            base = out[m.start() - 1] if m.start() else 0
            out[m.start() : m.end()] = np.frombuffer(self._counts_of(text[m.start() : m.end()]), COUNT) + base
        return out

    def _plain(self, text: str) -> np.ndarray:
        if len(text) <= BLOCK_CHARS:
            return self._block(text) if text else np.zeros(0, COUNT)
        out, base, at = np.empty(len(text), COUNT), 0, 0
        while at < len(text):
            cut = BLOCK_END.search(text, at + BLOCK_CHARS)
            end = cut.start() if cut else len(text)
            out[at:end] = self._block(text[at:end])
            out[at:end] += base
            base, at = int(out[end - 1]), end
        return out

    def counts(self, text: str | None) -> np.ndarray:
        """The token count of every prefix that ends after a character."""
        text = text or ""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        out, base, at = np.empty(len(text), COUNT), 0, 0
        for m in self.special.finditer(text):
            out[at : m.end() - 1] = self._plain(text[at : m.end() - 1])
            out[at : m.end() - 1] += base
            base = (int(out[m.start() - 1]) if m.start() > at else base) + 1
            out[m.end() - 1], at = base, m.end()
        out[at:] = self._plain(text[at:])
        out[at:] += base
        return out


def _longest(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def _over(df: DataFrame, text: Column, schema: T.StructType, work) -> DataFrame:
    """``work`` over batches of ``df`` with its texts; ``schema`` adds the columns that it returns."""
    small_batches(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch.column(len(names)))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + made, names=[*names, *schema.names])

    return df.select("*", text.alias("_text")).mapInArrow(run, T.StructType([*df.schema.fields, *schema.fields]))


def prefix_counts(docs: DataFrame, vocabulary: ByteVocabulary, text: str = "text", into: str = "prefix_counts") -> DataFrame:
    """The rows with one more column: the counts at all prefixes, a little-endian 32-bit integer for each character."""

    def work(texts: pa.Array) -> list[pa.Array]:
        counter = vocabulary.ready()
        return [pa.array((counter.counts(t).tobytes() for t in texts.to_pylist()), pa.binary())]

    return _over(docs, F.col(text), T.StructType([T.StructField(into, T.BinaryType())]), work)


def tokens_of_prefix(chars: Column, counts: str = "prefix_counts") -> Column:
    """The stored count at the prefix of so many characters; beyond the end that of the whole text."""
    at = F.least(chars.cast("int"), F.floor(F.octet_length(counts) / F.lit(4)).cast("int"))
    digits = F.hex(F.substring(F.col(counts), (at - 1) * 4 + 1, F.lit(4)))
    turned = F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)])
    return F.when(at <= 0, F.lit(0).cast("bigint")).otherwise(F.conv(turned, 16, 10).cast("bigint"))


def budget_questions(counted: DataFrame, budget: int, counts: str = "prefix_counts") -> DataFrame:
    """Answers from stored counts: all tokens, whether they pass the budget, the longest prefix within it, the ends of windows of it.

    Adds ``n_tokens``, ``over_limit``, ``fit_chars`` and ``window_ends`` (characters; each window is the
    longest piece after the one before it whose count grows by at most ``budget``).
    """
    added = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("fit_chars", T.LongType()), T.StructField("window_ends", T.ArrayType(T.LongType()))])

    def ends(held: np.ndarray) -> list[int]:
        out, at, base = [], 0, 0
        while at < len(held):
            step = max(_longest(held[at:] - base, budget), 1)
            at += step
            base = int(held[at - 1])
            out.append(at)
        return out

    def work(column: pa.Array) -> list[pa.Array]:
        held = [np.frombuffer(x or b"", COUNT) for x in column.to_pylist()]
        total = [int(x[-1]) if len(x) else 0 for x in held]
        return [pa.array(total, pa.int64()), pa.array([n > budget for n in total], pa.bool_()), pa.array([_longest(x, budget) for x in held], pa.int64()), pa.array([ends(x) for x in held], pa.list_(pa.int64()))]

    return _over(counted, F.col(counts), added, work)


def truncated(docs: DataFrame, vocabulary: ByteVocabulary, budget: int, text: str = "text") -> DataFrame:
    """The rows with ``text`` cut to its longest prefix of at most ``budget`` tokens."""
    added = T.StructType([T.StructField("_cut", T.StringType())])

    def work(texts: pa.Array) -> list[pa.Array]:
        counter = vocabulary.ready()
        return [pa.array([t and t[: _longest(counter.counts(t), budget)] for t in texts.to_pylist()], pa.string())]

    found = _over(docs, F.col(text), added, work)
    return found.select([F.col("_cut").alias(text) if c == text else F.col(c) for c in docs.columns])


def token_counts(docs: DataFrame, vocabulary: ByteVocabulary, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, fit_chars): size of each text, and of its longest prefix within ``limit`` tokens."""
    added = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("fit_chars", T.LongType())])

    def work(texts: pa.Array) -> list[pa.Array]:
        counter = vocabulary.ready()
        total, fit = [], []
        for t in texts.to_pylist():
            counts = counter.counts(t)
            total.append(int(counts[-1]) if len(counts) else 0)
            fit.append(len(counts) if total[-1] <= limit else _longest(counts, limit))
        return [pa.array(total, pa.int64()), pa.array([n > limit for n in total], pa.bool_()), pa.array(fit, pa.int64())]

    sized = docs.select(F.col(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"), F.coalesce(F.col(text), F.lit("")).alias("_whole"))
    small_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[key], T.StructField("n_bytes", T.LongType()), *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *work(batch.column(2))], names=schema.names)

    return sized.mapInArrow(run, schema)
