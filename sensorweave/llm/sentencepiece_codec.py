"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many distinct words lie in flat numpy arrays.  Each round takes the best pair rank of
every word (a segmented minimum), merges that pair at all its places in the word at once, from the
left, and compacts the arrays; it ends when no pair is left.

Merging all places at once equals the library's agenda, which merges one pair at a time, as long as
the new piece cannot form a better ranked pair with a neighbour.  Pieces that can (``safe`` is False)
are merged one place a round, the leftmost first.  A word of more than ``AGENDA_FROM`` symbols whose
best piece is of that kind is finished by the agenda itself, so that no word needs a round per symbol.

Defined results: a null text encodes as the empty text does (no ids, decoded to ""); characters
outside the vocabulary become their UTF-8 bytes' pieces; a text of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorweave.llm._flat import chunks
from sensorweave.llm._shared import small_batches

SPACE = "▁"
AGENDA_FROM = 400
CACHE_WORDS = 500_000
BLOCK_WORDS = 4_000
CACHE_LEN = 40


@dataclass
class PieceModel:
    """The vocabulary of a BPE model, as plain data that ships to executors."""

    pieces: list[str]
    scores: list[float]
    #: n normal, u unknown, c control, b byte
    kinds: str
    dummy_prefix: bool = True
    _ready: dict = field(default_factory=dict, repr=False, compare=False)

    @classmethod
    def load(cls, path: str) -> "PieceModel":
        """Reads the vocabulary of a model file; models of another kind than this class handles are refused."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        if any(model.is_unused(i) for i in ids):
            raise ValueError("vocabularies with unused pieces are not supported")
        if model.encode(" ", out_type=str) not in ([SPACE * 2], [SPACE, SPACE]):
            raise ValueError("only models with a dummy prefix and kept white space are supported")
        kinds = "".join("u" if model.is_unknown(i) else "c" if model.is_control(i) else "b" if model.is_byte(i) else "n" for i in ids)
        if "b" not in kinds:
            raise ValueError("only models with byte fallback are supported")
        return cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kinds)

    def __getstate__(self):
        return self.__dict__ | {"_ready": {}}

    def tables(self) -> dict:
        if not self._ready:
            self._ready.update(self._build())
        return self._ready

    def _build(self) -> dict:
        symbol = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == "n"}
        names = list(self.pieces)
        for p in [p for p in symbol if len(p) > 1]:
            for c in p:
                if c not in symbol:  # a character that only stands within pieces
                    symbol[c] = len(names)
                    names.append(c)
        n = len(names)
        order = sorted({-self.scores[i] for i in range(len(self.pieces)) if self.kinds[i] == "n"})
        rank_of_score = {s: r for r, s in enumerate(order)}
        rank = {p: rank_of_score[-self.scores[i]] for p, i in symbol.items() if i < len(self.pieces)}
        keys, merged, best_next = [], [], {}
        for p, i in symbol.items():
            if len(p) < 2 or i >= len(self.pieces):
                continue
            for k in range(1, len(p)):
                left, right = symbol.get(p[:k]), symbol.get(p[k:])
                if left is not None and right is not None:
                    keys.append(left * n + right)
                    merged.append(i)
                    for part in (p[:k], p[k:]):
                        if part in rank:
                            best_next[part] = min(best_next.get(part, 1 << 30), rank[p])
        by_key = np.argsort(np.array(keys, np.int64))
        ranks = np.full(n, 1 << 30, np.int32)
        safe = np.ones(n, bool)
        for p, i in symbol.items():
            if p in rank:
                ranks[i] = rank[p]
                safe[i] = best_next.get(p, 1 << 30) > rank[p]
        chars = np.full(0x110000, -1, np.int32)
        for p, i in symbol.items():
            if len(p) == 1:
                chars[ord(p)] = i
        byte_ids = [i for i, k in enumerate(self.kinds) if k == "b"]
        joined = {c for p in symbol if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        if any(SPACE in p.lstrip(SPACE) for p in symbol):
            raise ValueError("pieces that hold white space after a letter are not supported")
        pieces = [
            bytes([byte_ids.index(i)]) if k == "b" else b"" if k == "c" else b" \xe2\x81\x87 " if k == "u" else self.pieces[i].replace(SPACE, " ").encode()
            for i, k in enumerate(self.kinds)
        ]
        return {
            "n": n, "known": len(self.pieces), "names": names, "keys": np.array(keys, np.int64)[by_key], "merged": np.array(merged, np.int32)[by_key],
            "ranks": ranks, "safe": safe, "chars": chars, "byte_ids": byte_ids, "out": pieces, "strings": [str(i) for i in range(len(self.pieces))],
            "words": re.compile(f" *[^ {alone}]+|[{alone}]| +" if alone else " *[^ ]+| +"),
        }

    # -- words ---------------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """The parts of a text, dummy prefix included, across whose bounds no piece reaches."""
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, " ")
        return self.tables()["words"].findall(" " + text)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols merges to, or -1."""
        t = self.tables()
        key = left.astype(np.int64) * t["n"] + right
        key[(left >= t["n"]) | (right >= t["n"])] = -1
        at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        return np.where(t["keys"][at] == key, t["merged"][at], -1).astype(np.int32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and the number of ids of each word."""
        flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), BLOCK_WORDS):
            ids, n = self._rounds(words[a : a + BLOCK_WORDS])
            flat.append(ids)
            counts.append(n)
        return np.concatenate(flat), np.concatenate(counts)

    def _rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over one block of words."""
        t = self.tables()
        ranks, safe_piece, none = t["ranks"], t["safe"], np.int32(1 << 30)
        codes = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        sym = t["chars"][codes]
        sym = np.where(sym < 0, codes + np.int32(t["n"]), sym)  # characters outside the vocabulary stay apart
        wid = np.repeat(np.arange(len(words), dtype=np.int32), [len(w) for w in words])
        new, rank = np.full(len(sym), -1, np.int32), np.full(len(sym), none, np.int32)
        same = np.flatnonzero(wid[1:] == wid[:-1])
        new[same] = found = self._pairs(sym[same], sym[same + 1])
        rank[same] = np.where(found >= 0, ranks[found], none)
        done_sym, done_wid = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], wid[1:] != wid[:-1])))
            lengths = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            over = best == none
            if over.any():
                ended = np.repeat(over, lengths)
                done_sym.append(sym[ended])
                done_wid.append(wid[ended])
                keep = ~ended
                sym, wid, new, rank = sym[keep], wid[keep], new[keep], rank[keep]
                lengths, best = lengths[~over], best[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, lengths))
            of, piece = wid[at], new[at]
            safe = safe_piece[piece]
            leftmost = np.concatenate(([True], of[1:] != of[:-1]))
            if len(sym) > AGENDA_FROM and not safe.all():
                size = np.repeat(lengths, lengths)[at]
                slow = np.unique(of[~safe & leftmost & (size > AGENDA_FROM)])
                if len(slow):
                    for w in slow.tolist():
                        ended = self._agenda(sym[wid == w].tolist())
                        done_sym.append(np.array(ended, np.int32))
                        done_wid.append(np.full(len(ended), w, np.int32))
                    keep = ~np.isin(wid, slow)
                    sym, wid, new, rank = sym[keep], wid[keep], new[keep], rank[keep]
                    continue
            # of a run of overlapping places every second one merges, from the left; where pieces tie
            # in rank, only the piece that stands leftmost
            place = np.arange(len(at))
            run = leftmost.copy()
            run[1:] |= np.diff(at) != 1
            head = np.maximum.accumulate(np.where(run, place, 0))
            first = np.maximum.accumulate(np.where(leftmost, place, 0))
            at = at[((place - head) % 2 == 0) & (safe | leftmost) & (piece == piece[first])]
            sym[at] = new[at]
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, wid, new, rank, touched = sym[keep], wid[keep], new[keep], rank[keep], touched[keep]
            touched[:-1] |= touched[1:]
            redo = np.flatnonzero(touched)
            new[redo], rank[redo] = -1, none
            redo = redo[redo < len(sym) - 1]
            redo = redo[wid[redo] == wid[redo + 1]]
            new[redo] = found = self._pairs(sym[redo], sym[redo + 1])
            rank[redo] = np.where(found >= 0, ranks[found], none)
        wid, sym = np.concatenate(done_wid), np.concatenate(done_sym)
        order = np.argsort(wid, kind="stable")
        return self._bytes_for_unknown(sym[order], wid[order], len(words))

    def _bytes_for_unknown(self, sym: np.ndarray, wid: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        t = self.tables()
        if len(sym) and sym.max() >= t["known"]:
            ids: list[int] = []
            times = np.ones(len(sym), np.int64)
            for i, s in enumerate(sym.tolist()):
                if s < t["known"]:
                    ids.append(s)
                else:
                    raw = (t["names"][s] if s < t["n"] else chr(s - t["n"])).encode("utf-8", "surrogatepass")
                    ids += [t["byte_ids"][b] for b in raw]
                    times[i] = len(raw)
            sym, wid = np.array(ids, np.int32), np.repeat(wid, times)
        return sym, np.bincount(wid, minlength=n)

    def _agenda(self, sym: list[int]) -> list[int]:
        """One word, one merge at a time: the best rank first, then the leftmost."""
        t = self.tables()
        table = t.get("dict")
        if table is None:
            table = t["dict"] = dict(zip(t["keys"].tolist(), t["merged"].tolist(), strict=True))
        n, ranks = t["n"], t["ranks"]
        before, after = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        heap: list[tuple[int, int, int, int, int]] = []

        def add(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and sym[i] < n and sym[j] < n and (m := table.get(sym[i] * n + sym[j])) is not None:
                heapq.heappush(heap, (int(ranks[m]), i, sym[i], sym[j], m))

        for i in range(len(sym) - 1):
            add(i, i + 1)
        while heap:
            _, i, left, right, m = heapq.heappop(heap)
            j = after[i]
            if sym[i] != left or j < 0 or sym[j] != right:
                continue
            sym[i], sym[j] = m, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            add(before[i], i)
            add(i, after[i])
        return [s for s in sym if s >= 0]

    # -- texts ---------------------------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        split = [self.split(t or "") for t in texts]
        words = list(dict.fromkeys(w for ws in split for w in ws))
        flat, counts = self.encode_words(words)
        ends, ids = np.cumsum(counts).tolist(), flat.tolist()
        of = {w: ids[b - n : b] for w, b, n in zip(words, ends, counts.tolist(), strict=True)}
        return [[i for w in ws for i in of[w]] for ws in split]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        out = self.tables()["out"]
        return b"".join([out[i] for i in ids])

    def finish(self, raw: bytes, prefixed: bool = True) -> str:
        """Decoded pieces to text: the dummy prefix goes, bytes that are no UTF-8 become U+FFFD each."""
        if prefixed and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return _replaced(raw)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids."""
        ids = list(ids)
        first = next((i for i in ids if self.kinds[i] != "c"), None)
        return self.finish(self.decode_bytes(ids), first is not None and self.kinds[first] == "n")


def _replaced(raw: bytes) -> str:
    """UTF-8 with each byte of no valid character as one U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


class _Cached:
    """Ids (as text) of words seen before, for one Python worker.

    Each distinct word is decoded from its ids too.  Words that do not come back as they were are kept
    in ``odd``; a text without such a word decodes to its words in a row, any other one is decoded
    from its ids.
    """

    def __init__(self, model: PieceModel):
        self.model, self.known, self.odd = model, {}, set()

    def texts(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """The ids, joined by commas, and the decoded text of each text."""
        model, strings, out = self.model, self.model.tables()["strings"], self.model.tables()["out"]
        split = [model.split(t or "") for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known, self.odd = {}, set()
        known = self.known
        missing = list(set().union(*split).difference(known)) if split else []
        flat, counts = model.encode_words(missing)
        flat, ends = flat.tolist(), np.cumsum(counts).tolist()
        texts_of, bytes_of, a = [strings[i] for i in flat], [out[i] for i in flat], 0
        for word, b in zip(missing, ends, strict=True):
            known[word] = ",".join(texts_of[a:b])
            if b"".join(bytes_of[a:b]) != word.encode("utf-8", "surrogatepass"):
                self.odd.add(word)
            a = b
        for words in split:
            ids = ",".join([known[w] for w in words])
            if self.odd.isdisjoint(words) if self.odd else True:
                yield ids, "".join(words)[1:]
            else:
                yield ids, model.decode(map(int, ids.split(",")))
        for word in missing:
            if len(word) > CACHE_LEN:
                del known[word]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_column(df: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of ``text`` as array<int>; every other column stays, an older ``ids`` column goes."""
    df = df.drop(ids)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.encode(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, ids])

    return df.mapInArrow(run, schema)


def decode_column(df: DataFrame, model: PieceModel, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of ``ids``; null ids give the empty text."""
    df = df.drop(text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, schema)


def token_digests(df: DataFrame, model: PieceModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the number of ids, the SHA-256 of the ids joined by commas, that of the decoded text.

    One pass without a shuffle; ids are never held as a column.  The ids of a word are decoded once for
    each distinct word and checked against it, and a text's decoded form is made of its words' decoded
    forms.
    """
    small_batches(df.sparkSession)
    df = df.select(F.col(key), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = _Cached(model)
        for batch in batches:
            texts = batch.column(text).to_pylist()
            counts, ids_sha, text_sha = [], [], []
            for a, b in chunks(texts):
                for ids, decoded in cached.texts(texts[a:b]):
                    counts.append(ids.count(",") + 1 if ids else 0)
                    ids_sha.append(_sha(ids))
                    text_sha.append(_sha(decoded))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
