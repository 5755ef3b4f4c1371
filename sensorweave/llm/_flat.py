"""Flat numpy views of many texts at once: one byte buffer, token spans, token hashes.

Every helper works on whole texts.  A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Texts are handled in chunks of about this many bytes, so that memory does not follow the batch.
CHUNK_BYTES = 500_000

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``limit`` characters each; a longer text is a range of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    filled, b = 1, np.uint64(base)
    with np.errstate(over="ignore"):
        while filled < n:
            take = min(filled, n - filled)
            out[filled : filled + take] = out[:take] * (out[filled - 1] * b)
            filled += take
    return out


_BASE = 0x9E3779B97F4A7C15 | 1
_POW = _powers(1 << 16, _BASE)


def _pow(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = _powers(1 << int(n - 1).bit_length(), _BASE)
    return _POW


def byte_buffer(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in UTF-8 in one buffer, and the n+1 offsets of the texts."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def token_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs where ``is_word`` holds, none across texts; token counts by text."""
    n = len(is_word)
    if not n:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets) - 1, np.int64)
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = is_word[cuts]
    starts = np.flatnonzero(first)
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    last[cuts - 1] = is_word[cuts - 1]
    ends = np.flatnonzero(last) + 1
    at = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(at)


def token_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; the same bytes have the same hash in every text.

    Spans are taken in blocks of about ``CHUNK_BYTES``, so that a very long text needs no more than a chunk.
    """
    out = np.empty(len(starts), np.uint64)
    lengths = ends - starts
    sums = np.cumsum(lengths)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(sums, sums[at] - lengths[at] + CHUNK_BYTES, "right")))
        n = lengths[at:stop]
        begin = sums[at:stop] - n - (sums[at] - lengths[at])
        within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(begin, n)
        picked = buf[np.repeat(starts[at:stop], n) + within].astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            out[at:stop] = mix(np.add.reduceat(picked * _pow(int(n.max()))[within], begin) + n.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))
        at = stop
    return out


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of the n tokens from each place; the last n-1 places are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:m].copy()
        for k in range(1, n):
            out = mix(out * np.uint64(_BASE) + hashes[k : k + m])
    return out
