"""Plain spans against the patterns themselves; disguised ones by their source text."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lethe.llm import pii, queries

from .frames import DATA, clashing, documents, small

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(n - 9 * (n > 9) for n in doubled) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(kind, m.start(), m.end()) for kind, pattern in PATTERNS.items() for m in re.finditer(pattern, text) if valid(kind, m[0])]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="ab@.1925+-() %", max_size=60) | st.text(alphabet="a@.0", max_size=30) | st.text(alphabet="+12 ().-", max_size=40) | st.text(alphabet="4012 -.", max_size=60))
def test_plain_is_the_patterns(text):
    assert pii.ordered(pii.plain(text)) == pii.ordered(brute(text))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab@.19+ atdot[]oneа０​", max_size=80))
def test_plain_ones_stay_and_spans_lie_inside(text):
    base, spans = pii.spans_of(text)
    assert base == pii.ordered(brute(text)) and set(base) <= set(spans)
    assert all(0 <= a < b <= len(text) for _, a, b in spans)


@pytest.mark.parametrize(
    "text, kind, seen",
    [
        ("write to john.doe [at] mail [dot] example [dot] org now", "email", "john.doe [at] mail [dot] example [dot] org"),
        ("write to jane at mail dot example dot com, please", "email", "jane at mail dot example dot com"),
        ("mail bоb@exаmple.com today", "email", "bоb@exаmple.com"),
        ("mail bob＠example.com today", "email", "bob＠example.com"),
        ("mail bo​b@example.com today", "email", "bo​b@example.com"),
        ("call plus four four two zero seven nine four six zero nine five eight now", "phone", "plus four four two zero seven nine four six zero nine five eight"),
        ("call +４４ 20 7946 0958 now", "phone", "+４４ 20 7946 0958"),
        ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
        ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
        ("Ruf plus vier neun eins fünf eins eins zwei drei vier fünf sechs sieben an", "phone", "plus vier neun eins fünf eins eins zwei drei vier fünf sechs sieben"),
        ("le plus trois trois un quatre zéro cinq six sept huit neuf ici", "phone", "plus trois trois un quatre zéro cinq six sept huit neuf"),
        ("al más tres cuatro nueve uno cero dos tres cuatro cinco seis siete ya", "phone", "más tres cuatro nueve uno cero dos tres cuatro cinco seis siete"),
        ("call plus four    four two      zero seven nine four six zero nine five eight now", "phone", "plus four    four two      zero seven nine four six zero nine five eight"),
        ("write to jane at firm dot company today", "email", "jane at firm dot company"),
        ("write to jane (at)     firm.com today", "email", "jane (at)     firm.com"),
        ("write to jane     (  at  )     firm     [  dot  ]     com today", "email", "jane     (  at  )     firm     [  dot  ]     com"),
        ("Mail an anna at firma punkt de heute", "email", "anna at firma punkt de"),
        ("escribe a ana arroba empresa punto es hoy", "email", "ana arroba empresa punto es"),
        ("mail an anna arobase mail dot firma point fr vite", "email", "anna arobase mail dot firma point fr"),
        ("host 192[.]168[.]1[.]20 up", "ip", "192[.]168[.]1[.]20"),
    ],
)
def test_disguised(text, kind, seen):
    base, spans = pii.spans_of(text)
    assert not [s for s in base if s[0] == kind and text[s[1] : s[2]] == seen]
    assert (kind, text.index(seen), text.index(seen) + len(seen)) in spans
    assert seen not in pii.redact(text, spans) and f"[{kind.upper()}]" in pii.redact(text, spans)


@pytest.mark.parametrize("text", ["We met at noon and one dot was left.", "two or three of the five books at home", "look at the dot on the map", "one two three", "array[at] value", "look at this point in time", "écrire à x au point de vue", "null " * 20, "zero, zero, zero, zero, " * 4, "12    34    56    78    90    12    34    52", "", None])
def test_prose_stays(text):
    assert pii.spans_of(text) == ([], [])


def test_tables(spark):
    texts = [None, "", "a@b.co and a@b.co", "a@b.co and a@b.co", "x " * 50000 + "+44 20 7946 0958"]
    frame = clashing(documents(spark, texts))
    rows = {r["doc_id"]: r for r in pii.find(frame).collect()}
    assert {i: [tuple(s) for s in r["base"]] for i, r in rows.items()} == {i: brute(t or "") for i, t in enumerate(texts)}
    done = pii.redacted(frame)
    assert done.columns == frame.columns
    found = {r["doc_id"]: r for r in done.collect()}
    assert [found[i]["text"] for i in range(4)] == [None, "", "[EMAIL] and [EMAIL]", "[EMAIL] and [EMAIL]"] and found[4]["text"].endswith("x [PHONE]")
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in found.values())
    assert pii.summary(frame.where("doc_id < 0")).count() == 0 and pii.redacted(frame.where("doc_id < 0")).count() == 0


def test_query(spark):
    rows = {r["doc_id"]: r for r in queries.op10_pii(spark, DATA).collect()}
    assert len(rows) == len(small()) and any(brute(t or "") for _, t in small())
    for doc_id, text in small():
        base, r = brute(text or ""), rows[doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in base) for k in PATTERNS]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in pii.spans_of(text)[1])


@pytest.mark.parametrize("text, seen", [("call +49 oh 1511 2345678 now", "+49 oh 1511 2345678"), ("card 4111 1111 1111 111 one", "4111 1111 1111 111 one"), ("card one 411111111111111", None), ("call plus 44 20 7946 0958", "plus 44 20 7946 0958")])
def test_one_and_oh_are_digits(text, seen):
    assert [text[a:b] for _, a, b in pii.disguised(text, pii.plain(text))] == ([seen] if seen else [])


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["one", "oh", "seven", "ſix", "fıve", "acht", "zéro", "null", "punkt", "punto", "poınt", "arroba", "arobaſe", "es", "plus", "+", "point", "dot", "at", "[at]", " ", " ", "-", ".", ",", "4", "1111", "a", "b", "com", "０"]), max_size=40).map("".join) | st.text(max_size=40))
def test_filter_misses_nothing(text):
    base = pii.plain(text)
    assert pii.disguised(text, base) == pii.chain(text, base)


@pytest.mark.parametrize("end", "cz gr xyz kr tr ro hu ua online site com example museum".split())
def test_bare_words_with_any_top_level_domain(end):
    text = f"write to anna at firma dot {end} today"
    assert [text[a:b] for _, a, b in pii.disguised(text, [])] == [f"anna at firma dot {end}"]
    assert pii.disguised("look at this dot notadomain", []) == []


def test_prose_behind_an_address_stays():
    text = "écrivez à x@firm.com point de vente"
    assert [text[a:b] for _, a, b in pii.spans_of(text)[1]] == ["x@firm.com"]


@pytest.mark.parametrize("piece", [" ", "\t", "one", "one ", "null, ", "at ", "(", "( ", "at host ", " dot ", "a at b ", "1 ", "a@b point "])
def test_time_is_linear(piece):
    import time

    began = time.perf_counter()
    pii.spans_of(piece * (400_000 // len(piece)))
    assert time.perf_counter() - began < 30
