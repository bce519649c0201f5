"""Hashes of words straight from the bytes of an Arrow column, without a Python object for each.

Words are lower-cased over A-Z alone and parted by the six ASCII separators. A
word's hash is a polynomial over a table of its bytes' values, read off running
sums: the sum up to its end, less the one up to its start, shifted back to
place 0. Words of more than ``LONG`` bytes get xxHash instead, since a
polynomial modulo 2**64 can be fooled by long regular words.

A text goes through in pieces of ``PIECE`` bytes, cut between words, so its
length costs no more than eight bytes for each of its words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

from .common import scramble

PIECE = 1 << 17
LONG = 64
_BASE = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
VALUE = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))[LOWER]


def _powers(base: int) -> np.ndarray:
    """base ** k modulo 2**64, up to a piece's length."""
    out = np.ones(PIECE + 1, np.uint64)
    at, step = 1, base
    while at <= PIECE:
        out[at : 2 * at] = out[: min(at, PIECE + 1 - at)] * np.uint64(step)
        at, step = 2 * at, step * step % (1 << 64)
    return out


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _long(raw: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(LOWER[raw].tobytes())


def _piece(raw: np.ndarray, is_separator: np.ndarray) -> np.ndarray:
    up, down = _tables()
    edges = np.flatnonzero(is_separator[1:] != is_separator[:-1]) + 1
    if not is_separator[0]:
        edges = np.append(0, edges)
    if not is_separator[-1]:
        edges = np.append(edges, len(raw))
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(VALUE[raw] * up[: len(raw)], out=sums[1:])
    size = end - begin
    out = (sums[end] - sums[begin]) * down[begin] ^ size.astype(np.uint64)
    for k in np.flatnonzero(size > LONG):
        out[k] = _long(raw[begin[k] : end[k]])
    return out


def word_hashes(raw: np.ndarray, separators: np.ndarray = SEPARATOR) -> np.ndarray:
    """The hash of each word of a text's UTF-8 bytes, in order. separators: which bytes part words."""
    out, at = [], 0
    while at < len(raw):
        part = raw[at : at + PIECE]
        is_separator = separators[part]
        if at + len(part) < len(raw):
            last = len(part) - 1 - int(np.argmax(is_separator[::-1]))
            if not is_separator[last]:  # a word longer than the piece
                end = at + len(part)
                while end < len(raw) and not (found := separators[raw[end : end + PIECE]]).any():
                    end += len(found)
                end = min(len(raw), end + (int(np.argmax(found)) if end < len(raw) else 0))
                out.append(np.array([_long(raw[at:end])], np.uint64))
                at = end
                continue
            part, is_separator = part[: last + 1], is_separator[: last + 1]
        out.append(_piece(part, is_separator))
        at += len(part)
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)


#: Bytes of letters: those of ASCII, and of any character beyond it.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def letter_words(raw: np.ndarray, heads: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of each different run of letters: its hash, and a row of hashes of its
    first so many bytes, 0 where it's shorter. Runs longer than a piece, and
    those across its end, are cut there."""
    up, down = _tables()
    hashes, firsts = [np.zeros(0, np.uint64)], [np.zeros((0, len(heads)), np.uint64)]
    for at in range(0, len(raw), PIECE):
        part = raw[at : at + PIECE]
        is_letter = LETTER[part]
        edges = np.flatnonzero(is_letter[1:] != is_letter[:-1]) + 1
        edges = np.concatenate([[0] * int(is_letter[0]), edges, [len(part)] * int(is_letter[-1])]).astype(np.int64)
        begin, end = edges[::2], edges[1::2]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(VALUE[part] * up[: len(part)], out=sums[1:])
        found, first = np.unique((sums[end] - sums[begin]) * down[begin], return_index=True)
        begin, end = begin[first], end[first]
        hashes.append(found)
        rows = np.zeros((len(found), len(heads)), np.uint64)
        for k, n in enumerate(heads):
            long = np.flatnonzero(end - begin >= n)
            rows[long, k] = (sums[begin[long] + n] - sums[begin[long]]) * down[begin[long]]
        firsts.append(rows)
    if len(hashes) == 2:
        return hashes[1], firsts[1]
    found, first = np.unique(np.concatenate(hashes), return_index=True)
    return found, np.concatenate(firsts)[first]
