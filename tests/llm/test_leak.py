import base64
import quopri
import random
import unicodedata

import pytest
import regex

from stratalog.llm.leak import Automaton, find_spans, leaked_spans, leaks, normalised, remove_spans, word_places
from stratalog.llm.mime import text_parts

WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(s):
    return WORD.findall(normalised(s))


def brute(texts, passages, least):
    out = set()
    for p, s in enumerate(passages):
        grams = {tuple(w[i : i + least]) for w in [words(s)] for i in range(len(w) - least + 1)}
        for t, x in enumerate(texts):
            for part in text_parts(x):
                w = words(part)
                if any(tuple(w[i : i + least]) in grams for i in range(len(w) - least + 1)):
                    out.add((t, p))
    return out


def found(texts, a):
    return {(t, p) for t, _, _, _, _, got in find_spans(texts, [a]) for p in got}


def test_automaton_against_brute_force():
    r = random.Random(4)
    for trial in range(60):
        alphabet = [f"w{i}" for i in range(r.choice([2, 3, 8, 40]))]
        passages = [" ".join(r.choice(alphabet) for _ in range(r.randrange(0, 30))) for _ in range(r.randrange(1, 8))]
        passages += r.sample(passages, 1)
        texts = [" ".join(r.choice([*alphabet, "other"]) for _ in range(r.randrange(0, 60))) for _ in range(10)]
        texts += ["lead in " + p + " tail" for p in passages] + [None, ""]
        least = r.choice([2, 3, 5])
        a = Automaton(passages, least)
        assert found(texts, a) == brute(texts, passages, least), trial


def test_lengths_and_places():
    a = Automaton(["a b c d e f g", "x y z c d e q"], 3)
    assert list(find_spans(["1 2 a b c d e q 9"], [a])) == [(0, 0, 2, 5, 0, {0: 5, 1: 3}), (0, 0, 4, 4, 0, {1: 4})]


PASSAGE = "The paper mill near Ivatorquen held 972 visitors, although nobody in Quénist had asked for an Account."
HEAD = "From: a@b.example\nSubject: x\nMIME-Version: 1.0\n"


def has(message):
    return any(PASSAGE_WORDS in " ".join(words(p)) for p in text_parts(message))


PASSAGE_WORDS = " ".join(words(PASSAGE))


def test_encodings():
    utf = PASSAGE.encode()
    qp = quopri.encodestring(utf).decode()
    b64 = base64.encodebytes(utf).decode()
    plain = "Content-Type: text/plain; charset=utf-8\n"
    messages = [
        HEAD + "\n" + PASSAGE,
        PASSAGE,
        "\n" + PASSAGE,
        HEAD + plain + "Content-Transfer-Encoding: quoted-printable\n\n" + qp,
        HEAD + plain + "Content-Transfer-Encoding: BASE64\n\n" + b64,
        HEAD + plain + "Content-Transfer-Encoding: base64\n\n" + b64.rstrip("=\n")[:-1] + b64.rstrip("=\n")[-1:],
        HEAD + 'Content-Type: text/plain;\n charset="iso-8859-1"\nContent-Transfer-Encoding: quoted-printable\n\n' + quopri.encodestring(PASSAGE.encode("latin-1")).decode(),
        HEAD + "\n" + "\n".join("> " * (i % 3) + w for i, w in enumerate(PASSAGE.split())),
        HEAD + "\n" + "\n\n".join("|> " + w for w in PASSAGE.split()),
        HEAD + "Content-Type: text/html\n\n<html><p>" + PASSAGE.replace("held", "<b>held</b>").replace("é", "&eacute;").replace("nobody", "no<i>body</i>").replace(" for", "<br/>for") + "</p>",
        HEAD + "\n" + PASSAGE.upper(),
        HEAD + "\n" + unicodedata.normalize("NFD", PASSAGE),
        (HEAD + "\n" + PASSAGE).replace("\n", "\r\n"),
        (HEAD + "\n" + PASSAGE).replace("\n", "\r"),
        HEAD + 'Content-Type: multipart/mixed; boundary="b+1"\n\npreamble\n--b+1\n' + plain + "\nhello\n--b+1\nContent-Type: multipart/alternative; boundary=inner\n\n--inner\n" + plain + "Content-Transfer-Encoding: base64\n\n" + b64 + "\n--inner--\n--b+1--\n",
        HEAD + "Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: text/plain; name=notes.txt\nContent-Disposition: attachment; filename=notes.txt\nContent-Transfer-Encoding: base64\n\n" + b64,
        HEAD + 'Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: application/octet-stream; name="notes.txt"\nContent-Transfer-Encoding: base64\n\n' + b64 + "\n--b--",
        HEAD + "Content-Type: message/rfc822\n\n" + HEAD + "\n" + PASSAGE,
        HEAD + 'Content-Type: multipart/mixed; boundary="never"\n\n' + PASSAGE,
    ]
    assert [i for i, m in enumerate(messages) if not has(m)] == []


def test_what_is_no_text_part():
    b64 = base64.encodebytes(PASSAGE.encode()).decode()
    image = HEAD + "Content-Type: multipart/mixed; boundary=b\n\n--b\nContent-Type: image/png; name=x.png\nContent-Transfer-Encoding: base64\n\n" + b64 + "\n--b--"
    two = HEAD + "Content-Type: multipart/mixed; boundary=b\n\n--b\n\n" + PASSAGE[:50] + "\n--b\n\n" + PASSAGE[50:] + "\n--b--"
    style = HEAD + "Content-Type: text/html\n\n<style>" + PASSAGE + "</style>x"
    assert not any(map(has, [image, two, style, None, "", "   ", HEAD + "Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n=!?"]))


@pytest.mark.parametrize("depth", [1, 19, 20, 21, 2000])
def test_nested_however_deep(depth):
    nested = "".join(f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n" for i in range(depth))
    assert has(nested + "Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes(PASSAGE.encode()).decode())
    assert has("Content-Type: message/rfc822\n\n" * depth + HEAD + "\n" + PASSAGE)


def test_multipart_without_boundary():
    assert has(HEAD + "Content-Type: multipart/mixed\n\n--b\nContent-Type: text/plain\n\n" + PASSAGE + "\n--b--")
    assert has(HEAD + "Content-Type: multipart/mixed; boundary=a\n\n--a\nContent-Type: multipart/alternative\n\n" + PASSAGE)


def test_garbage_does_not_crash():
    r = random.Random(6)
    bits = ["\n", "\r\n", "--b", "--b--", "Content-Type: multipart/mixed; boundary=b", "Content-Type: text/html", "Content-Transfer-Encoding: base64", "quoted-printable=", "=E9=", "&#xZZ; &amp", "<", ">", "<!--", ": ", "퟿", "é", "AAAA", "\x00"]
    for _ in range(500):
        list(text_parts("".join(r.choice(bits) for _ in range(r.randrange(40)))))
    deep = "".join(f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n" for i in range(100)) + PASSAGE
    assert isinstance(list(text_parts(deep)), list)


def frames(spark):
    docs = [(1, HEAD + "\n" + PASSAGE, "x"), (1, HEAD + "\n" + PASSAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "nothing here", "x"), (5, "intro words " + PASSAGE + " and a longer tail of words that nobody else has written down anywhere before this day", "x")]
    items = [(10, PASSAGE, "q"), (11, PASSAGE, "r"), (12, None, "s"), (None, PASSAGE, "s"), (13, "too short", "t"), (14, "", "t")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, t string"), spark.createDataFrame(items, "item_id bigint, passage string, d string")


def test_leaks_frame(spark):
    docs, items = frames(spark)
    args = ("doc_id", "text", items, "item_id", "passage")
    assert {tuple(r) for r in leaks(docs, *args).collect()} == {(d, i, 17) for d in (1, 5) for i in (10, 11)}
    assert leaks(docs, *args).count() == 4
    assert {tuple(r) for r in leaked_spans(docs, *args).collect()} == {(1, 0, 0, 17), (5, 0, 2, 17)}
    cleaned = {r.doc_id: r for r in remove_spans(docs, *args).collect()}
    assert cleaned[1].kept_text is None and cleaned[1].coverage == 1
    assert cleaned[5].kept_text == "intro words . and a longer tail of words that nobody else has written down anywhere before this day"
    for f in (leaks, leaked_spans, remove_spans):
        assert f(docs.limit(0), *args).count() == 0
        assert f(docs, "doc_id", "text", items.limit(0), "item_id", "passage").count() == 0


@pytest.mark.parametrize("max_words", [5, 30, 10**6])
def test_many_automata_give_one_result(spark, monkeypatch, max_words):
    """Two leaks of 20 words in a part of 49: however passages are dealt to automata, both go together."""
    from stratalog.llm import leak

    monkeypatch.setattr(leak, "MAX_WORDS", max_words)
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    docs = spark.createDataFrame([(1, f"x y z {one} p q r {two} s t u"), (2, f"x y z {one} " + "w " * 60), (3, "none of it")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, one), (2, two), (3, two), (4, " ".join(one.split()[:15]) + " else")], "item_id bigint, passage string")
    args = ("doc_id", "text", items, "item_id", "passage")
    assert {tuple(r) for r in leaks(docs, *args).collect()} == {(1, 1, 20), (1, 2, 20), (1, 3, 20), (1, 4, 15), (2, 1, 20), (2, 4, 15)}
    assert sorted(tuple(r) for r in leaked_spans(docs, *args).collect()) == [(1, 0, 3, 20), (1, 0, 26, 20), (2, 0, 3, 20)]
    cleaned = {r.doc_id: r for r in remove_spans(docs, *args).collect()}
    assert cleaned.keys() == {1, 2} and cleaned[1].kept_text is None and round(cleaned[1].coverage, 2) == 0.82
    assert cleaned[2].kept_text.startswith("x y z  w w")
    docs, items = frames(spark)
    assert leaks(docs, "doc_id", "text", items, "item_id", "passage").count() == 4


def test_word_places_keep_the_letters():
    for s in ("İstanbul and İzmir, the STRASSE of Groß", "plain text", "a\u0345b c", "e\u0301tude X", "ǰx ΰy", ""):
        own, at = word_places(s)
        assert own == unicodedata.normalize("NFC", s) and len(at) == len(words(s))
        assert all(own[b:e] for b, e in at)
    own, at = word_places("İstanbul İzmir")
    assert [own[b:e] for b, e in at] == ["İ", "stanbul", "İ", "zmir"]
