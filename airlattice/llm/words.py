"""Words of many texts at once, as 64-bit hashes, straight from an Arrow buffer.

A word is a run of letters and digits in lower case (ASCII and Latin-1 letters are lowered). Left out are punctuation,
underscores, the letter of a backslash escape, markup tags and entities; a \\uXXXX escape stands for its character. What
stands between < and > is a tag if it is short, or, at any length, if it is made like one, of a name and attributes of which
one is quoted; likewise an entity if it is short or of letters and digits. A text that is null has no words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD1342543DE82EF95)
CHUNK_BYTES = 2_000_000  #: texts are taken together up to so many bytes, to stay within the processor's cache
SHORT_TAG, SHORT_ENTITY = 100, 8  #: up to so many bytes whatever is marked so is taken for one
_QUOTED = re.compile(rb"""=\s*\\?["']""")
_TAG = re.compile(rb"""<(?:!--[^<>]*--|/?[A-Za-z][\w:-]*(?:\s+[\w:@.-]+(?:\s*=\s*(?:\\?"[^"<>]*"|\\?'[^'<>]*'|[^\s"'<>=]+))?)*\s*/?)>""")

_LOWER = np.zeros(256, np.uint8)
for _c in range(256):
    _ch = chr(_c)
    if _c >= 128 or (_ch.isascii() and _ch.isalnum()):
        _LOWER[_c] = ord(_ch.lower()) if _c < 128 else _c
_HEX = np.full(256, -1, np.int32)
for _c in b"0123456789abcdefABCDEF":
    _HEX[_c] = int(chr(_c), 16)
_ESCAPED = np.zeros(256, bool)
_ESCAPED[list(b"nrtbf")] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"/!abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
class _Powers:
    """Powers of the hash's base and of its inverse, grown as needed; sent to other processes without its tables."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up, down = np.full(n, _P), np.full(n, _P_INV)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up, self.down


_power_tables = _Powers()


def _between(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions from first to last, both included."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _clean(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(bytes in lower case with 0 for whatever is no word, mask of the bytes to keep or None)."""
    b, n, keep = _LOWER[raw], len(raw), None
    back = np.flatnonzero(raw[:-1] == 92)
    if len(back):
        b[back[_ESCAPED[raw[back + 1]]] + 1] = 0
        u = back[(raw[back + 1] == 117) & (back + 5 < n)]
        if len(u):
            digits = _HEX[raw[u[:, None] + np.arange(2, 6)]]
            u, digits = u[(digits >= 0).all(1)], digits[(digits >= 0).all(1)]
            code = digits @ np.array([4096, 256, 16, 1], np.int32)
            for j in range(1, 6):
                b[u + j] = 0
            two = (code >= 0xC0) & (code < 0x800)
            b[u[two]], b[u[two] + 1] = 0xC0 | (code[two] >> 6), 0x80 | (code[two] & 63)
            ascii_ = code < 0x80
            b[u[ascii_]] = _LOWER[code[ascii_]]
            drop = np.concatenate([u[two] + j for j in range(2, 6)] + [u[ascii_] + j for j in range(1, 6)])
            if len(drop):
                keep = np.ones(n, bool)
                keep[drop] = False
    wide = np.flatnonzero(raw >= 0xC2)
    if len(wide):
        lead = raw[wide]
        after = raw[np.minimum(wide + 1, n - 1)]
        upper = wide[(lead == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97) & (wide + 1 < n)]
        b[upper + 1] += 0x20
        # Latin-1 signs, general punctuation, arrows and box drawing, and ideographic punctuation are no letters.
        for at, size in ((wide[lead == 0xC2], 2), (wide[lead == 0xE2], 3), (wide[(lead == 0xE3) & (after == 0x80)], 3)):
            for j in range(size):
                b[np.minimum(at + j, n - 1)] = 0
    le = np.flatnonzero(raw == 60)
    if len(le):
        gt = np.flatnonzero(raw == 62)
        if len(gt):
            at = np.minimum(np.searchsorted(gt, le), len(gt) - 1)
            end, following = gt[at], np.append(le[1:], n)
            tag = (end > le) & (end < following) & _MARK[raw[np.minimum(le + 1, n - 1)]]
            for i in np.flatnonzero(tag & (end - le > SHORT_TAG)):
                mark = raw[le[i] : end[i] + 1].tobytes()
                tag[i] = (_QUOTED.search(mark) or mark[1:2] == b"!") and _TAG.fullmatch(mark) is not None
            if tag.any():
                b[_between(le[tag], end[tag], n)] = 0
    amp = np.flatnonzero(raw == 38)
    if len(amp):
        semi = np.flatnonzero(raw == 59)
        if len(semi):
            end = semi[np.minimum(np.searchsorted(semi, amp), len(semi) - 1)]
            entity = end > amp + 1
            for i in np.flatnonzero(entity & (end - amp > SHORT_ENTITY) & (end - amp <= 40)):
                entity[i] = raw[amp[i] + 1 : end[i]].tobytes().isalnum()
            entity &= end - amp <= 40  # no name of an entity is longer
            if entity.any():
                b[_between(amp[entity], end[entity], n)] = 0
    return b, keep


def _chunk(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, length in bytes, whether it is of letters only) of every word; ends: where each text ends."""
    if not len(raw):
        z = np.empty(0, np.int64)
        return z.astype(np.uint64), z, z, z.astype(bool)
    b, keep = _clean(raw)
    if keep is not None:
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        b = b[keep]
    n = len(b)
    word = b != 0
    starts_text = np.zeros(n + 1, bool)
    starts_text[np.concatenate([[0], ends])] = True
    before = np.concatenate([[False], word[:-1]])
    start = np.flatnonzero(word & (~before | starts_text[:-1]))
    after = np.concatenate([word[1:], [False]])
    end = np.flatnonzero(word & (~after | starts_text[1:])) + 1
    up, down = _power_tables(n)
    total = np.concatenate([[np.uint64(0)], np.cumsum(b * up[:n], dtype=np.uint64)])
    h = (total[end] - total[start]) * down[start]
    h = (h ^ (h >> np.uint64(29))) * _Q
    h ^= h >> np.uint64(32)
    digits = np.concatenate([[0], np.cumsum((b >= 48) & (b <= 57))])
    return h, np.searchsorted(ends, start, "right"), end - start, digits[end] == digits[start]


def of_texts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of whole texts: (first text, number of texts, word hashes, each word's text from 0, lengths, letters only)."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
            raw = data[offsets[first] : offsets[last]]
            yield (first, last - first, *_chunk(raw, offsets[first + 1 : last + 1] - offsets[first]))
            first = last


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` words in a row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(size):
            h = h * _Q + words[j : j + n]
        h = (h ^ (h >> np.uint64(31))) * _P
        return h ^ (h >> np.uint64(30))
