"""Evaluation passages inside training texts, by a generalised suffix automaton of the passages."""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.mime import text_parts
from stratalog.llm.scan import Words, class_table, identities, padded, text_bytes, word_spans

#: Words of test passages, and items, that one automaton holds (about 100 bytes each in a reader, ten times that while the driver builds it); further
#: passages go into further automata, of which a reader holds one at a time.
MAX_WORDS = 300_000
#: Bytes of normalised text that are scanned at once; with several automata more, as each chunk meets all of them.
CHUNK, WIDE_CHUNK = 2 << 20, 8 << 20


def normalised(s: str) -> str:
    """s without case, in composed form."""
    if s.isascii():
        return s.lower()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", s).casefold())


def _spans(texts: Iterable[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of all texts: the two words of their identity, and where each text's words begin; last, the padded bytes."""
    raw, off = text_bytes(pa.array([t.encode("utf-8", "replace") for t in texts], pa.large_binary()))
    buf = padded(raw)
    a, z = word_spans(buf, off, table)
    return *identities(buf, a, z - a), np.searchsorted(a, off), buf


class Automaton:
    """A generalised suffix automaton over the words of passages, held in arrays.

    A state stands for the word sequences that end at the same places of the passages; ``link`` leads to the state of their longest proper
    suffix elsewhere. A state's items are the passages that hold its sequences, kept of states of at least ``least`` words."""

    def __init__(self, passages: list[str], least: int):
        if least < 2:
            raise ValueError("a match has two words at least")
        self.least = least
        k, k2, first, _ = _spans(map(normalised, passages), class_table())
        _, at, back = np.unique(np.stack([k, k2]), axis=1, return_index=True, return_inverse=True) if len(k) else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.words = Words()
        number = self.words.add(k[at], k2[at])[back]
        strings = [number[first[i] : first[i + 1]].tolist() for i in range(len(passages))]

        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        for s in strings:
            last = 0
            for w in s:
                last = self._extend(nxt, link, length, last, w)
        holds: list[set[int]] = [set() for _ in nxt]
        for i, s in enumerate(strings):
            at_state = 0
            for w in s:
                at_state = nxt[at_state][w]
                p = at_state
                while p > 0 and length[p] >= least and i not in holds[p]:
                    holds[p].add(i)
                    p = link[p]

        n = self.words.n
        moves = np.array(sorted((s * n + w, t) for s, d in enumerate(nxt) for w, t in d.items()), np.int64).reshape(-1, 2)
        self.move, self.target = array("q", moves[:, 0].tolist()), array("i", moves[:, 1].tolist())
        self.link, self.length = array("i", link), array("i", length)
        self.item_at = array("i", np.cumsum([0, *map(len, holds)]).tolist())
        self.item = array("i", [i for h in holds for i in sorted(h)])
        pairs = [np.array(s[:-1], np.int64) * n + np.array(s[1:], np.int64) for s in strings if len(s) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)

    @staticmethod
    def _extend(nxt: list[dict[int, int]], link: list[int], length: list[int], last: int, w: int) -> int:
        """The state of the current passage's words up to w, given that of the words before it. Its transition may exist from an earlier
        passage: then that state is taken, or split if it also stands for longer sequences."""
        cur, p = -1, last
        if w not in nxt[last]:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p < 0:
                return cur
        q = nxt[p][w]
        if length[q] != length[p] + 1:
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            length.append(length[p] + 1)
            link.append(link[q])
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            link[q] = q = clone
        if cur < 0:
            return q
        link[cur] = q
        return cur

    def step(self, state: int, w: int) -> int:
        """The state after one more word, -1 if there is none."""
        k = state * self.words.n + w
        i = bisect_left(self.move, k)
        return self.target[i] if i < len(self.move) and self.move[i] == k else -1

    def note(self, state: int, n: int, best: dict[int, int]) -> None:
        """Raises in best, of each passage, its longest match, by a match of n words that ends in state: passages of the state hold all n words, those that only
        its suffixes stand in hold as many as the suffix has."""
        while n >= self.least:
            for i in self.item[self.item_at[state] : self.item_at[state + 1]]:
                if best.get(i, 0) < n:
                    best[i] = n
            state = self.link[state]
            n = self.length[state]

    def scan(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """Where at least ``least`` words up to here match: (the last word's place, the longest matching length, its state)."""
        state, n = 0, 0
        for i, w in enumerate(words):
            to = self.step(state, w)
            while to < 0 and state:
                state = self.link[state]
                n = self.length[state]
                to = self.step(state, w)
            if to < 0:
                n = 0
                continue
            state, n = to, n + 1
            if n >= self.least:
                yield i, n, state


def _candidates(a: Automaton, number: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """Stretches that could hold a match, as (text, first word's place in it, words): at least ``least`` words in a row of one text that
    the passages know, each with its neighbour."""
    if len(number) < a.least or not len(a.pairs):
        return
    known = number >= 0
    pair = number[:-1].astype(np.int64) * a.words.n + number[1:]
    i = np.minimum(np.searchsorted(a.pairs, pair), len(a.pairs) - 1)
    joined = known[:-1] & known[1:] & (a.pairs[i] == pair)
    joined[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(number))] - 1] = False
    edge = np.flatnonzero(np.diff(np.r_[False, joined, False].astype(np.int8)))
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if e - s + 1 >= a.least:
            t = int(np.searchsorted(first, s, "right")) - 1
            yield t, s - int(first[t]), number[s : e + 1].tolist()


def find_spans(texts: list[str | None], automata: Iterable[Automaton]) -> Iterator[tuple[int, int, int, int, int, dict[int, int]]]:
    """(text, part, start word, words, automaton, passages with the words that each has of it) of each longest match of at least ``least`` words in the parts of raw messages. automata is gone
    through once for each chunk of text, which is decoded once; a text's spans come together, in no order."""
    owner: list[tuple[int, int]] = []
    parts: list[str] = []
    size, chunk = 0, CHUNK if len(automata) < 2 else WIDE_CHUNK

    def flush() -> Iterator[tuple[int, int, int, int, int, dict[int, int]]]:
        k, k2, first, _ = _spans(parts, class_table())
        for nth, a in enumerate(automata):
            for t, start, words in _candidates(a, a.words.find(k, k2), first):
                end, n, got = -1, 0, {}
                for i, m, r in a.scan(words):
                    if m != n + 1 or i != end + 1:  # an earlier match ended: matches may overlap, each is a span
                        if end >= 0:
                            yield *owner[t], start + end - n + 1, n, nth, got
                        got = {}
                    end, n = i, m
                    a.note(r, m, got)
                if end >= 0:
                    yield *owner[t], start + end - n + 1, n, nth, got

    for i, s in enumerate(texts):
        if size > chunk:
            yield from flush()
            owner, parts, size = [], [], 0
        for j, p in enumerate(text_parts(s)):
            owner.append((i, j))
            parts.append(normalised(p))
            size += len(p)
    if parts:
        yield from flush()


class Automata:
    """Automata with the items of their passages, each broadcast by itself. A reader keeps the last one that it used, so a single automaton is loaded
    once and several never lie in memory together."""

    def __init__(self, held: list[Broadcast]):
        self.held = held
        self._last: tuple[int, tuple[Automaton, list[list[int]]]] | None = None

    def __getstate__(self) -> list[Broadcast]:
        return self.held

    def __setstate__(self, held: list[Broadcast]) -> None:
        self.__init__(held)

    def __len__(self) -> int:
        return len(self.held)

    def get(self, i: int) -> tuple[Automaton, list[list[int]]]:
        if self._last is None or self._last[0] != i:
            self._last = None
            b = self.held[i]
            got = b.value if len(self.held) == 1 else b.load_from_path(b._path)  # value would stay in the reader
            self._last = i, got
        return self._last[1]

    def __iter__(self) -> Iterator[Automaton]:
        for i in range(len(self.held)):
            yield self.get(i)[0]


def _automata(items: DataFrame, item_id: str, passage: str, least: int) -> Automata:
    """Automata of at most about MAX_WORDS words and items. Equal passages are held once in each. They are built one after the other and kept by the broadcast, not
    by the driver's Python."""
    sc = items.sparkSession.sparkContext
    rows = items.select(F.col(item_id).cast("long"), passage).where(F.col(passage).isNotNull() & F.col(item_id).isNotNull())
    out: list[Broadcast] = []
    held: dict[str, list[int]] = {}
    size = 0
    for i, p in rows.toLocalIterator():
        size += 1 + (len(p) // 4 if p not in held else 0)
        held.setdefault(p, []).append(i)
        if size > MAX_WORDS:
            out.append(sc.broadcast((Automaton(list(held), least), list(held.values()))))
            held, size = {}, 0
    if held:
        out.append(sc.broadcast((Automaton(list(held), least), list(held.values()))))
    return Automata(out)


def _over(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, least: int, schema: str, rows: Callable[[list, list, Iterator, Automata], Iterator[tuple]]) -> DataFrame:
    """The rows of one pass over docs. rows: from the ids and texts of a batch, its spans and the automata."""
    read = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("string").alias("t"))
    kinds = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}[t]) for n, t in (x.split() for x in schema.split(", "))])
    automata = _automata(items, item_id, passage, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("d").to_pylist(), batch.column("t").to_pylist()
            got = list(rows(ids, texts, find_spans(texts, automata), automata))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], f.type) for i, f in enumerate(kinds)], schema=kinds)

    return read.mapInArrow(run, schema) if len(automata) else read.where("false").mapInArrow(lambda batches: iter(()), schema)


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, least: int = 12) -> DataFrame:
    """One row for each document and item of whose passage at least ``least`` words in a row stand in one text part of the message:
    doc_id, item_id, longest (words of the longest match with the item's passage).

    Words are longest runs of letters and digits, compared without case in composed form, after transfer encoding, HTML and quote marks
    are undone. Null and empty texts and passages match nothing, nor do passages of fewer words; null ids never come out of items.
    Repeated documents or items each count; of rows that share a doc_id each is searched and the pairs are joined.

    The passages' automata are broadcast: the size of each is bounded by MAX_WORDS, and more passages mean more automata, which every chunk of decoded
    text meets in turn. Texts stream by in batches; only the pairs found are shuffled."""

    def rows(ids: list, _: list, spans: Iterator, automata: Automata) -> Iterator[tuple]:
        best: dict[tuple[int, int], int] = {}
        for t, _, _, _, nth, got in spans:
            own = automata.get(nth)[1]
            for p, n in got.items():
                for i in own[p]:
                    best[ids[t], i] = max(n, best.get((ids[t], i), 0))
        yield from ((d, i, n) for (d, i), n in best.items())

    found = _over(docs, doc_id, text, items, item_id, passage, least, "doc_id bigint, item_id bigint, longest int", rows)
    return found.groupBy("doc_id", "item_id").agg(F.max("longest").alias("longest"))


def merged_spans(spans: Iterator[tuple[int, int, int, int, int, dict[int, int]]]) -> dict[int, dict[int, list[tuple[int, int]]]]:
    """Of each text and part the (start, end) words of its spans; overlapping and touching ones are one."""
    held: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for t, p, s, n, *_ in spans:
        held.setdefault(t, {}).setdefault(p, []).append((s, s + n))
    for parts in held.values():
        for p, ss in parts.items():
            out: list[tuple[int, int]] = []
            for s, e in sorted(ss):
                if out and s <= out[-1][1]:
                    out[-1] = (out[-1][0], max(e, out[-1][1]))
                else:
                    out.append((s, e))
            parts[p] = out
    return held


def leaked_spans(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, least: int = 12) -> DataFrame:
    """The matched spans: doc_id, part (number of the text part), start_word, words. Spans of one part don't overlap, however many automata the passages
    take."""

    def rows(ids: list, _: list, spans: Iterator, automata: Automata) -> Iterator[tuple]:
        for t, parts in merged_spans(spans).items():
            yield from ((ids[t], p, s, e - s) for p, ss in parts.items() for s, e in ss)

    return _over(docs, doc_id, text, items, item_id, passage, least, "doc_id bigint, part int, start_word int, words int", rows)


_WORD = re.compile(r"[^\W_]+")
#: A character with the combining ones that follow it.
_CLUSTER = re.compile(r".[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u0610-\u061a\u064b-\u065f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]*", re.S)


def word_places(s: str) -> tuple[str, list[tuple[int, int]]]:
    """s in composed form, and where each word of its compared form stands in it. Where a change of case makes one word two, as with a dotted capital I,
    or words of what was none, the places follow from the signs that they came from; a sign cut by a word's end belongs to the word."""
    own = unicodedata.normalize("NFC", s)
    at = [m.span() for m in _WORD.finditer(own)]
    plain = normalised(s)
    if len(at) == sum(1 for _ in _WORD.finditer(plain)):
        return own, at
    made, source = [], []
    for m in _CLUSTER.finditer(own):
        part = normalised(m[0])
        made.append(part)
        source += [m.span()] * len(part)
    if "".join(made) != plain:  # signs that compose across clusters: cut the compared form
        return plain, [m.span() for m in _WORD.finditer(plain)]
    return own, [(source[m.start()][0], source[m.end() - 1][1]) for m in _WORD.finditer(plain)]


def remove_spans(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, least: int = 12, max_coverage: float = 0.5) -> DataFrame:
    """The text parts that hold leaked spans, cleaned: doc_id, part, words, leaked_words, coverage, kept_text.

    A span of at least ``least`` words is cut out, from its first word to its last; where more than max_coverage of a part's words are
    leaked the part goes whole and kept_text is null. Spans of all passages count together, however many automata they take. kept_text has the part's own
    letters, in composed form. Documents without a leak don't come out: they stay as they are."""

    def rows(ids: list, texts: list, spans: Iterator, automata: Automata) -> Iterator[tuple]:
        for t, parts in merged_spans(spans).items():
            decoded = list(text_parts(texts[t]))
            for p, ss in parts.items():
                s, at = word_places(decoded[p])
                leaked = sum(e - b for b, e in ss)
                kept, last = [], 0
                for b, e in ss:
                    kept.append(s[last : at[b][0]])
                    last = max(last, at[e - 1][1])
                kept.append(s[last:])
                yield ids[t], p, len(at), leaked, leaked / len(at), "".join(kept) if leaked <= max_coverage * len(at) else None

    return _over(docs, doc_id, text, items, item_id, passage, least, "doc_id bigint, part int, words int, leaked_words int, coverage double, kept_text string", rows)
