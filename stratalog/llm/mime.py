"""The text parts of raw e-mail, as plain text. Lenient: whatever is broken is read as far as it goes."""

from __future__ import annotations

import base64
import binascii
import html
import re
from collections.abc import Iterator

_BLANK = re.compile(r"\r?\n[ \t]*\r?\n|\r[ \t]*\r")
_FOLD = re.compile(r"(?:\r\n|\n|\r)[ \t]+")
_TYPE = re.compile(r"^content-type:[ \t]*([^\s;]*)([^\r\n]*)", re.I | re.M)
_CODING = re.compile(r"^content-transfer-encoding:[ \t]*([\w-]+)", re.I | re.M)
_DISPOSITION = re.compile(r"^content-disposition:[^\r\n]*", re.I | re.M)
_BOUNDARY = re.compile(r'boundary[ \t]*=[ \t]*(?:"([^"\r\n]*)"|([^\s;"]+))', re.I)
_CHARSET = re.compile(r"charset[ \t]*=[ \t]*[\"']?([\w.:-]+)", re.I)
_NAME = re.compile(r'name\*?[ \t]*=[ \t]*(?:"([^"\r\n]*)"|([^\s;"]+))', re.I)
_NOT_B64 = re.compile(r"[^A-Za-z0-9+/]")
_SILENT = re.compile(r"<!--.*?-->|<(style|script)\b.*?</\1\s*>", re.I | re.S)
#: Tags that run inside a word; all others end it.
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|mark|q|s|small|span|strong|sub|sup|tt|u|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>")
_QUOTE = re.compile(r"^[ \t]*(?:[>|][ \t]?)+", re.M)
#: Names of attached files that hold text, whatever type they are sent as.
_TEXT_FILE = re.compile(r"\.(?:txt|text|md|csv|tsv|log|htm|html|eml|patch|diff)$", re.I)
_HEADER = re.compile(r"[!-9;-~]+:")


def _decoded(body: str, coding: str, charset: str) -> str:
    if coding == "quoted-printable":
        raw = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
        # signs outside ASCII that stood there undone are UTF-8 now, whatever the charset says
        order = ("utf-8", charset) if not body.isascii() else (charset, "utf-8")
    elif coding == "base64":
        data = _NOT_B64.sub("", body)
        try:
            raw = base64.b64decode(data[: len(data) // 4 * 4] if len(data) % 4 == 1 else data + "=" * (-len(data) % 4))
        except (binascii.Error, ValueError):
            return body
        order = (charset, "utf-8")
    else:
        return body
    for c in order:
        try:
            return raw.decode(c)
        except (UnicodeDecodeError, LookupError):
            pass
    return raw.decode("utf-8", "replace")


def html_text(s: str) -> str:
    """The text of HTML: no comments, styles, scripts or tags, entities undone. Tags end a word unless they are inline."""
    if "<" in s:
        s = _TAG.sub(" ", _INLINE.sub("", _SILENT.sub(" ", s)))
    return html.unescape(s) if "&" in s else s


def unquoted(s: str) -> str:
    """s without quote marks at line starts."""
    return _QUOTE.sub("", s) if ">" in s or "|" in s else s


def _split(s: str) -> tuple[str, str]:
    """Header block and body. Text that doesn't begin like a header, or has no blank line, is all body."""
    if s[:1] in "\r\n":
        return "", s.lstrip("\r\n")
    m = _BLANK.search(s)
    head = s[: m.start()] if m else s
    if not _HEADER.match(head):
        return "", s
    return head, s[m.end() :] if m else s


def _cut(body: str, mark: str) -> list[str]:
    """What lies between the lines of a boundary, with "--" after each line that closes it, else "", in between."""
    out, last, at, n = [], 0, 0, len(body)
    while (i := body.find(mark, at)) >= 0:
        at = i + 1
        if i and body[i - 1] not in "\r\n":
            continue
        k = i + len(mark)
        end = "--" if body.startswith("--", k) else ""
        k += len(end)
        while k < n and body[k] in " \t":
            k += 1
        if k < n and body[k] not in "\r\n":
            continue
        out += [body[last:i], end]
        last = at = min(n, k + 1 + body.startswith("\r\n", k))
    return [*out, body[last:]]


def text_parts(s: str | None) -> Iterator[str]:
    """Each text part of a message (plain, HTML, an attached text file), decoded, as plain text. Multiparts, also unclosed and nested
    ones, and attached messages are entered however deep they lie; the body of a multipart that names no boundary is text."""
    todo = [(s, True)] if s else []  # what is still to be read, the next one last; false: text that has no header
    while todo:
        s, headed = todo.pop()
        if not headed:
            yield unquoted(s)
            continue
        head, body = _split(s)
        head = _FOLD.sub(" ", head)
        t = _TYPE.search(head)
        kind, rest = (t[1].lower(), t[2]) if t else ("text/plain", "")
        if kind.startswith("multipart/") and (b := _BOUNDARY.search(rest)):
            mark = "--" + (b[1] if b[1] is not None else b[2]).rstrip()
            pieces = _cut(body, mark)
            inner = [(pieces[0], False)] if pieces[0].strip() else []
            closed = False
            for end, piece in zip(pieces[1::2], pieces[2::2], strict=True):
                closed |= bool(end)
                # what follows the last part is text of the message or nothing
                if piece.strip() if closed else piece:
                    inner.append((piece, not closed))
            todo += reversed(inner)
            continue
        c = _CODING.search(head)
        coding = c[1].lower() if c else ""
        m = _CHARSET.search(rest)
        name = ""
        if not kind.startswith(("text/", "multipart/")):
            d = _DISPOSITION.search(head)
            n = _NAME.search(d[0] if d else "") or _NAME.search(rest)
            name = (n[1] or n[2] or "") if n else ""
            if kind != "message/rfc822" and not _TEXT_FILE.search(name) and kind:
                continue
        text = _decoded(body, coding, m[1] if m else "utf-8")
        if kind == "message/rfc822":
            if text:
                todo.append((text, True))
        elif kind == "text/html" or name.lower().endswith((".htm", ".html")):
            yield unquoted(html_text(text))
        else:
            yield unquoted(text)
