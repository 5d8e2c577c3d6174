"""Byte-level BPE over whole partitions by a pair occurrence index."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from stratalog.llm.scan import Words, class_table, gather, identities, padded, text_bytes, token_starts

#: Bytes of text that are held at once, and that are split at once. A longer text is held by itself.
CHUNK, SLICE = 8 << 20, 1 << 20
#: From so many places on a pair is merged by array operations.
MANY = 48
#: Words that a tokenizer remembers between chunks; beyond, it starts anew.
REMEMBER = 1 << 21


def byte_signs() -> list[str]:
    """The character that stands for each byte in the vocabulary files: printable bytes are themselves, others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in plain else chr(0x100 + n))
        n += b not in plain
    return out


class Vocabulary:
    """Merges of a byte-level BPE as arrays; about a megabyte, whatever the corpus."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.key = hashlib.sha256(data).hexdigest()
        model = json.loads(data)["model"]
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        self.of_byte = np.array([vocab[s] for s in byte_signs()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left, self.right, self.made = (np.array(x, np.int32) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        #: Bytes of each token.
        self.width = np.zeros(self.size, np.int32)
        for t, i in vocab.items():
            self.width[i] = len(t)
        self.table = class_table()


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the bytes of each token of a vocabulary begin, how many they are, and the bytes of all tokens."""
    with open(path, "rb") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte_of = {sign: i for i, sign in enumerate(byte_signs())}
    texts = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        texts[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
    width = np.array([len(t) for t in texts], np.int64)
    return np.cumsum(width) - width, width, np.frombuffer(b"".join(texts), np.uint8)


class PairIndexBPE:
    """Encodes texts. Words (pieces of the split) are told apart by identity, so each distinct word of a chunk is merged once.

    Merging works on all new words of a chunk together: an index maps each pair of neighbouring symbols to all its places; pairs are
    taken in ascending rank, merged at all their places, and the lists of the pairs that this makes or breaks are updated. A
    pair made by a merge always ranks behind it, so one ascending pass is exact."""

    def __init__(self, v: Vocabulary):
        self.v, n = v, v.size
        key = v.left.astype(np.int64) * n + v.right
        order = np.argsort(key)
        self.keys, self.key_rank = key[order], order.astype(np.int32)
        self.rank_of = dict(zip(key.tolist(), range(len(key)), strict=True))
        first = np.full((n,), -1, np.int32)
        first[v.of_byte] = np.arange(256)
        self.byte_pair = np.full(1 << 16, len(key), np.int32)
        a, b = first[v.left], first[v.right]
        both = (a >= 0) & (b >= 0)
        self.byte_pair[(a[both].astype(np.int64) << 8) | b[both]] = np.flatnonzero(both)
        self._forget()

    def _forget(self) -> None:
        self.words, self.ids, self.off = Words(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merge(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words raw[off[i]:off[i+1]], none of them empty, one after the other, and the offsets of their ids."""
        n, v, size, none = len(raw), self.v, self.v.size, len(self.rank_of)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        sym = v.of_byte[raw]
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[off[1:] - 1] = -1
        prv[off[:-1]] = -1
        rank = np.full(n, none, np.int32)
        rank[:-1] = self.byte_pair[(raw[:-1].astype(np.int32) << 8) | raw[1:]]
        rank[off[1:] - 1] = none
        places = np.argsort(rank, kind="stable").astype(np.int32)
        bounds = np.searchsorted(rank[places], np.arange(none + 1))
        del rank
        counts = np.diff(bounds)
        later: dict[int, list[int]] = {}
        sm, nm, pm = memoryview(sym), memoryview(nxt), memoryview(prv)
        rank_of, keys, key_rank = self.rank_of, self.keys, self.key_rank
        has = (counts > 0).tolist()
        bl = bounds.tolist()
        left, right, made = v.left.tolist(), v.right.tolist(), v.made.tolist()
        for r in range(none):
            more = later.pop(r, None)
            if more is None and not has[r]:
                continue
            a, b, m = left[r], right[r], made[r]
            own = places[bl[r] : bl[r + 1]]
            if len(own) + (len(more) if more else 0) >= MANY and a != b:
                p = np.unique(np.concatenate([own, np.array(more, np.int32)])) if more else own
                p = p[sym[p] == a]
                q = nxt[p]
                ok = q >= 0
                p, q = p[ok], q[ok]
                ok = sym[q] == b
                p, q = p[ok], q[ok]
                sym[p], sym[q] = m, -1
                nn = nxt[q]
                nxt[p] = nn
                ok = nn >= 0
                prv[nn[ok]] = p[ok]
                before = prv[p]
                okb = before >= 0
                at = np.concatenate([before[okb], p[ok]])
                pair = np.concatenate([sym[before[okb]].astype(np.int64) * size + m, m * size + sym[nn[ok]].astype(np.int64)])
                i = np.minimum(np.searchsorted(keys, pair), none - 1)
                known = keys[i] == pair
                for rr, pp in zip(key_rank[i[known]].tolist(), at[known].tolist(), strict=True):
                    if rr in later:
                        later[rr].append(pp)
                    else:
                        later[rr] = [pp]
                continue
            todo = own.tolist()
            if more:
                todo = sorted(todo + more)
            base = m * size
            for p in todo:
                if sm[p] != a:
                    continue
                q = nm[p]
                if q < 0 or sm[q] != b:
                    continue
                sm[p] = m
                sm[q] = -1
                nn = nm[q]
                nm[p] = nn
                if nn >= 0:
                    pm[nn] = p
                    rr = rank_of.get(base + sm[nn])
                    if rr is not None:
                        if rr in later:
                            later[rr].append(p)
                        else:
                            later[rr] = [p]
                pp = pm[p]
                if pp >= 0:
                    rr = rank_of.get(sm[pp] * size + m)
                    if rr is not None:
                        if rr in later:
                            later[rr].append(pp)
                        else:
                            later[rr] = [pp]
        keep = sym >= 0
        total = np.zeros(n + 1, np.int64)
        np.cumsum(keep, out=total[1:])
        return sym[keep], total[off]

    def words_of(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts raw[off[i]:off[i+1]]: the number of each word, the start byte of each word, and the offsets of the texts' words."""
        if self.words.n > REMEMBER:
            self._forget()
        numbers, begins, firsts = [], [], [np.zeros(1, np.int64)]
        fresh: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        count, i = 0, 0
        while i < len(off) - 1:
            j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
            part, o = padded(raw[off[i] : off[j]]), off[i : j + 1] - off[i]
            s = token_starts(part, o, self.v.table)
            ln = np.diff(np.append(s, o[-1]))
            k, k2 = identities(part, s, ln)
            w = self.words.find(k, k2)
            miss = np.flatnonzero(w < 0)
            if miss.size:
                # distinct by the first word of the identity; the rare span that shares it but differs in the second stays unnumbered
                _, at, back = np.unique(k[miss], return_index=True, return_inverse=True)
                same = k2[miss] == k2[miss[at]][back]
                ids = self.words.add(k[miss[at]], k2[miss[at]])
                got = ids[back]
                odd = miss[~same]
                if odd.size:
                    got[~same] = np.arange(self.words.n, self.words.n + odd.size, dtype=np.int32)
                    self.words.n += odd.size
                w[miss] = got
                new = np.concatenate([miss[at], odd])
                b, bo = gather(part, s[new], ln[new])
                fresh.append(b)
                sizes.append(np.diff(bo))
            numbers.append(w)
            begins.append(s + off[i])
            firsts.append(np.searchsorted(s, o[1:]) + count)
            count += len(w)
            i = j
        if fresh:
            z = np.zeros(sum(map(len, sizes)) + 1, np.int64)
            np.cumsum(np.concatenate(sizes), out=z[1:])
            ids, io = self.merge(np.concatenate(fresh), z)
            self.off = np.concatenate([self.off, io[1:] + self.off[-1]])
            self.ids = np.concatenate([self.ids, ids])
        none = np.zeros(0, np.int64)
        return np.concatenate(numbers) if numbers else none.astype(np.int32), np.concatenate(begins) if begins else none, np.concatenate(firsts)

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words by number, one after the other, and the offsets of each word's."""
        return gather(self.ids, self.off[numbers], self.off[numbers + 1] - self.off[numbers])

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Ranges of rows whose texts have about CHUNK bytes in all, with those bytes and the offsets of each text."""
        raw, off = text_bytes(texts)
        i = 0
        while i < len(texts):
            j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
            yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j

    def encode(self, texts: pa.Array) -> Iterator[pa.ListArray]:
        """The ids of each text, in order, a chunk of texts at a time."""
        for _, _, raw, off in self.chunks(texts):
            w, _, first = self.words_of(raw, off)
            ids, at = self.ids_of(w)
            yield pa.ListArray.from_arrays(pa.array(at[first].astype(np.int32)), pa.array(ids))
