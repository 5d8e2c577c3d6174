"""Pieces of oversized messages, cut at the natural boundaries of their structure."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.bpe import PairIndexBPE
from stratalog.llm.tokenize import BYTE_BPE_50K, encoder, shared_vocabulary

#: Strength of the boundary in front of a line or sentence; a node of the tree is what lies between two boundaries of its strength.
PART, BLOCK, PARAGRAPH, LINE, SENTENCE, WORD = 6, 5, 4, 3, 2, 1

#: First signs of quoted lines, of lines that may open a block, and of lines over a quotation that don't end in a colon.
_MARKS, _OPENERS, _FROM = (frozenset(s[i : i + 1] for i in range(len(s))) for s in (b">|", b"#=-*_+0123456789<", b"fF"))
_DEPTH = re.compile(rb"[ \t]*((?:[>|][ \t]?)*)")
#: Starts of lines that open a block: headings, list items, block tags, rules, the lines over a quotation.
_OPENS = re.compile(rb"(?:#{1,6} |={3,}|-{3,}|\*{3,}|_{3,}|[-*+] |\d{1,3}[.)] |</?(?:p|div|table|tr|ul|ol|li|h[1-6]|hr|body|blockquote|section|article|pre)\b|-----)", re.I)
#: Lines that stand over a quotation and belong to it.
_LEADS = re.compile(rb"(?:[^\r\n]{1,120}\bwrote\b[^\r\n]{0,80}:|From: [^\r\n]{1,200})[ \t]*$", re.I)
#: Ends of sentences, among them the ideographic full stop.
_SENTENCE = re.compile(rb"[.!?][\"')\]]*\s+(?=\S)|\xe3\x80\x82")
_BOUNDARY = re.compile(rb'boundary[ \t]*=[ \t]*(?:"([^"\r\n]*)"|([^\s;"]+))', re.I)


def boundaries(raw: bytes) -> list[tuple[int, int]]:
    """(byte offset, strength) of the boundaries in front of lines and sentences of a message, ascending, each offset once."""
    marks = {b"--" + (m[1] if m[1] is not None else m[2]).rstrip() for m in _BOUNDARY.finditer(raw)}
    out: list[tuple[int, int]] = []
    blank, depth, head, first, led = False, 0, True, True, False
    at = 0
    # most lines are plain: the patterns are only asked about lines that begin or end like those they match
    for line in raw.splitlines(keepends=True):
        bare = line.strip()
        inner, text, now = line.lstrip(), bare, 0
        if bare[:1] in _MARKS:
            q = _DEPTH.match(line)
            now = q[1].count(b">") + q[1].count(b"|")
            inner = line[q.end() :].lstrip()
            text = inner.rstrip()
        leads = not head and (text[-1:] == b":" or text[:1] in _FROM) and bool(_LEADS.match(text))
        if marks and bare.startswith(b"--") and (bare in marks or bare[:-2] in marks):
            s, head, leads = PART, True, False  # the part's own header block follows
        elif not bare:
            s = LINE
            if head:
                head, s = False, BLOCK
        elif led:
            s = LINE
        elif now != depth or leads:
            s = BLOCK
        elif inner[:1] in _OPENERS and _OPENS.match(inner):
            s = BLOCK if blank or inner[:1] == b"<" else PARAGRAPH
        else:
            s = PARAGRAPH if blank else LINE
        if not first:
            out.append((at, s))
        first = False
        if not head and (b"." in line or b"!" in line or b"?" in line or b"\xe3\x80\x82" in line):
            end = at + len(line)
            out += [(x.end(), SENTENCE) for x in _SENTENCE.finditer(raw, at, end) if at < x.end() < end]
        if bare:
            depth = now
        led = leads
        blank = not bare or bare[:1] in _MARKS and not bare.strip(b">| \t")
        at += len(line)
    return out


def pack(cuts: np.ndarray, strengths: np.ndarray, n: int, limit: int) -> list[int]:
    """Ends of consecutive spans of 0..n of at most ``limit`` units. cuts: ascending places in 1..n-1 with the strengths of the boundaries there.

    The boundaries are a tree: a node of strength s is what lies between neighbouring boundaries of at least s. A node within the limit is
    one span; an oversized one is taken apart into its children, each packed by itself, and then neighbouring spans are merged from
    the left while they fit. Where even a node without inner boundaries is oversized, it is cut at the limit."""

    def go(a: int, z: int, lo: int, hi: int, s: int) -> list[int]:
        if z - a <= limit:
            return [z]
        while s and not (inner := np.flatnonzero(strengths[lo:hi] >= s) + lo).size:
            s -= 1
        if not s:
            return [*range(a + limit, z, limit), z]
        ends: list[int] = []
        edges = [(a, lo)] + [(int(cuts[i]), int(i) + 1) for i in inner]
        for i, (b, first) in enumerate(edges):
            e, last = (edges[i + 1][0], edges[i + 1][1] - 1) if i + 1 < len(edges) else (z, hi)
            for end in go(b, e, first, last, s - 1) if e - b > limit else [e]:
                begin = ends[-2] if len(ends) > 1 else a
                if ends and end - begin <= limit:
                    ends[-1] = end
                else:
                    ends.append(end)
        return ends

    return go(0, n, 0, len(cuts), PART) if n else []


def pieces(raw: bytes, starts: np.ndarray, counts: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges of the pieces of an oversized text. starts: the first byte of each word; counts: tokens before each word, and in all."""
    n = int(counts[-1])
    room = limit - overlap
    found = boundaries(raw)
    # a boundary holds from the word that begins there or, inside a word, from that word
    word = np.searchsorted(starts, np.array([b for b, _ in found], np.int64), "right") - 1 if found else np.zeros(0, np.int64)
    strength = np.zeros(len(starts), np.int64) + WORD
    np.maximum.at(strength, word, np.array([s for _, s in found], np.int64))
    at = counts[:-1]
    keep = (at > 0) & (at < n)
    ends = pack(at[keep], strength[keep], n, room)
    if len(ends) > 1 and ends[0] <= overlap:  # the first piece has no overlap to fit in, so it can take the next span too
        ends = ends[1:]
    return [(max(0, (ends[i - 1] if i else 0) - overlap), e) for i, e in enumerate(ends)]


def split_oversized(df: DataFrame, doc_id: str, text: str, limit: int = 2048, overlap: int = 128, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens: doc_id, piece (from 0), first_token, n_tokens, doc_tokens, piece_text.

    A piece is a run of the text's own tokens, at most limit of them; each piece begins with the last ``overlap`` tokens of the one before,
    and the rest of it ends at the strongest boundary that keeps pieces large: between parts of the message, blocks (quotations with the line over them,
    headings, list items, HTML blocks), paragraphs, lines, sentences, words. Only a single word larger than the limit is cut inside.
    piece_text is what these tokens stand for; a character that a cut divides (possible only at the overlap's start or inside
    such a word) shows as U+FFFD. Texts within the limit, null and empty ones give no rows. Rows with one doc_id are split each
    by itself. A text of fewer bytes than tokens allowed can't exceed the limit and isn't encoded. No row moves."""
    if not 0 <= 2 * overlap < limit:
        raise ValueError("overlap must be less than half the limit")
    b = shared_vocabulary(df.sparkSession, vocabulary)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("t")).where(F.octet_length("t") > limit)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, first_token int, n_tokens int, doc_tokens int, piece_text string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(b)
        for batch in batches:
            for i, _, raw, off in e.chunks(batch.column("t")):
                which, cols = _pieces_of(e, raw, off, limit, overlap)
                ids = batch.column("doc_id").take(pa.array(which + i))
                yield pa.RecordBatch.from_arrays([ids, *cols], names=names)

    return rows.mapInArrow(run, schema)


def _pieces_of(e: PairIndexBPE, raw: np.ndarray, off: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, list[pa.Array]]:
    w, begin, first = e.words_of(raw, off)
    sizes = e.off[w + 1] - e.off[w]
    before = np.zeros(len(w) + 1, np.int64)
    np.cumsum(sizes, out=before[1:])
    totals = before[first[1:]] - before[first[:-1]]
    which, num, at, n, of, texts = [], [], [], [], [], []
    for i in np.flatnonzero(totals > limit).tolist():
        a, z = int(first[i]), int(first[i + 1])
        data = raw[off[i] : off[i + 1]].tobytes()
        starts, counts = begin[a:z] - off[i], before[a : z + 1] - before[a]
        for k, (s, t) in enumerate(pieces(data, starts, counts, limit, overlap)):
            which.append(i)
            num.append(k)
            at.append(s)
            n.append(t - s)
            of.append(int(totals[i]))
            texts.append(data[_byte_of(e, w[a:z], starts, counts, s, len(data)) : _byte_of(e, w[a:z], starts, counts, t, len(data))].decode("utf-8", "replace"))
    i32 = pa.int32()
    return np.array(which, np.int64), [pa.array(num, i32), pa.array(at, i32), pa.array(n, i32), pa.array(of, i32), pa.array(texts, pa.string())]


def _byte_of(e: PairIndexBPE, words: np.ndarray, starts: np.ndarray, counts: np.ndarray, token: int, size: int) -> int:
    """The byte at which a token begins."""
    if token >= counts[-1]:
        return size
    i = int(np.searchsorted(counts, token, "right")) - 1
    skip = e.ids[e.off[words[i]] : e.off[words[i]] + token - int(counts[i])]
    return int(starts[i]) + sum(e.v.width[x] for x in skip.tolist())
