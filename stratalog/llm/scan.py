"""Vectorised scanning of UTF-8 text: character classes, token starts and identities, over the bytes of many texts at once."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points of the Unicode property White_Space (fixed values).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def class_table() -> np.ndarray:
    """The class of each code point."""
    first = "".join(unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)).encode()
    c = np.frombuffer(first, np.uint8)
    out = np.full(len(c), OTHER, np.uint8)
    out[c == ord("L")] = LETTER
    out[c == ord("N")] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the offset of each text with the end. Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not wide and not (pa.types.is_string(texts.type) or pa.types.is_binary(texts.type)):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def padded(raw: np.ndarray) -> np.ndarray:
    """raw with eight zero bytes behind it, which the functions below read but don't count."""
    return np.concatenate([raw, np.zeros(8, np.uint8)])


def classes(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each byte of a padded buffer: that of its character."""
    n = len(buf) - 8
    c = table[:256][buf[:n]]
    lead = np.flatnonzero(buf[:n] >= 0xC0)
    if lead.size:
        b0, b1, b2, b3 = (buf[lead + j].astype(np.int32) for j in range(4))
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        b1, b2, b3 = b1 & 63, b2 & 63, b3 & 63
        cp = np.where(size == 2, (b0 & 31) << 6 | b1, np.where(size == 3, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        kind = table[np.minimum(cp, len(table) - 1)]
        c[lead] = kind
        for j in (1, 2, 3):
            m = (size > j) & (lead + j < n)
            c[lead[m] + j] = kind[m]
    return c


def token_starts(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where the pieces begin into which the byte-level tokenizers' pattern splits each text of a padded buffer:
    contractions, then letters, numbers or other signs with one space before, then white space."""
    n = len(buf) - 8
    if not n:
        return np.zeros(0, np.int64)
    c, b = classes(buf, table), buf[:n]
    begin = np.zeros(n + 1, bool)
    begin[off] = True
    s = np.empty(n, bool)
    s[0] = True
    space = c == SPACE
    np.not_equal(c[1:], c[:-1], out=s[1:])
    s[1:] &= (b[:-1] != 0x20) | space[1:]
    # the last white space before something else stands alone or joins it
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~begin[1:n])
    wide = last[b[last] >= 0x80]
    s[last[b[last] < 0x80]] = True
    for _ in range(3):
        wide = np.where((b[wide] & 0xC0) == 0x80, wide - 1, wide)
    s[wide] = True
    s |= begin[:n]
    q = np.flatnonzero((b == 0x27) & s)
    if q.size:
        x, y = buf[q + 1], buf[q + 2]
        in1, in2 = ~begin[np.minimum(q + 1, n)], ~begin[np.minimum(q + 2, n)] & (q + 2 < n)
        one = in1 & np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = in1 & in2 & ~one & (((x == ord("r")) & (y == ord("e"))) | ((x == ord("v")) & (y == ord("e"))) | ((x == ord("l")) & (y == ord("l"))))
        for at, k in ((q[one], 2), (q[two], 3)):
            s[at + 1] = False
            end = at + k
            s[end[end < n]] = True
    return np.flatnonzero(s)


def word_spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each longest run of letters and digits; a run ends with its text."""
    n = len(buf) - 8
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = classes(buf, table)
    word = (c == LETTER) | (c == NUMBER)
    begin = np.zeros(n + 1, bool)
    begin[off] = True
    edge = np.zeros(n + 1, bool)
    edge[1:n] = word[1:] != word[:-1]
    edge |= begin
    edge[0] = edge[n] = True
    at = np.flatnonzero(edge)
    keep = word[at[:-1]]
    return at[:-1][keep], at[1:][keep]


_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def identities(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each span of a padded buffer: equal spans have equal ones. Up to 7 bytes they hold the bytes themselves; of longer
    spans they are two independent hashes, 127 bits in all."""
    at = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))
    first = at[starts]
    k = (first & _MASK[np.minimum(lens, 8)]) | (lens.astype(np.uint64) << np.uint64(56))
    k2 = np.zeros(len(k), np.uint64)
    long = np.flatnonzero(lens > 7)
    if long.size:
        s, left = starts[long].copy(), lens[long].copy()
        h, g = left.astype(np.uint64) * _B, left.astype(np.uint64) + _A
        todo = np.arange(len(long))
        while todo.size:
            w = at[s[todo]] & _MASK[np.minimum(left[todo], 8)]
            x = (h[todo] ^ w) * _A
            h[todo] = x ^ (x >> np.uint64(29))
            y = (g[todo] + w) * _B
            g[todo] = y ^ (y >> np.uint64(31))
            s[todo] += 8
            left[todo] -= 8
            todo = todo[left[todo] > 0]
        k[long] = h | np.uint64(1 << 63)
        k2[long] = g
    return k, k2


class Words:
    """Numbers spans by identity: an open-addressing table held in arrays and asked for many spans at once."""

    def __init__(self, bits: int = 17):
        self.n, self.bits = 0, bits
        self.k, self.k2 = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.at = np.full(1 << bits, -1, np.int32)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        x = k * _A
        x ^= x >> np.uint64(32)
        return ((x * _B) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, k: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """The number of each identity, -1 for an unknown one."""
        slot = self._slot(k)
        got = self.at[slot]
        hit = (self.k[slot] == k) & (self.k2[slot] == k2)
        out = np.where(hit & (got >= 0), got, np.int32(-1))
        todo = np.flatnonzero((got >= 0) & ~hit)
        while todo.size:
            slot[todo] = (slot[todo] + 1) & (len(self.at) - 1)
            s = slot[todo]
            got = self.at[s]
            hit = (got >= 0) & (self.k[s] == k[todo]) & (self.k2[s] == k2[todo])
            out[todo[hit]] = got[hit]
            todo = todo[(got >= 0) & ~hit]
        return out

    def _put(self, k: np.ndarray, k2: np.ndarray, ids: np.ndarray) -> None:
        slot, todo = self._slot(k), np.arange(len(k))
        while todo.size:
            free = todo[self.at[slot[todo]] < 0]
            self.at[slot[free]] = ids[free]
            won = free[self.at[slot[free]] == ids[free]]
            self.k[slot[won]], self.k2[slot[won]] = k[won], k2[won]
            done = np.zeros(len(k), bool)
            done[won] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.at) - 1)

    def add(self, k: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Numbers new, distinct identities from n on."""
        ids = np.arange(self.n, self.n + len(k), dtype=np.int32)
        self.n += len(k)
        if 2 * self.n > len(self.at):
            full = np.flatnonzero(self.at >= 0)
            old = self.k[full], self.k2[full], self.at[full]
            while 2 * self.n > 1 << self.bits:
                self.bits += 1
            self.k, self.k2 = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
            self.at = np.full(1 << self.bits, -1, np.int32)
            self._put(*old)
        self._put(k, k2, ids)
        return ids


def gather(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the spans, one after the other, and their offsets with the end."""
    off = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=off[1:])
    return buf[np.repeat(starts - off[:-1], lens) + np.arange(off[-1])], off
