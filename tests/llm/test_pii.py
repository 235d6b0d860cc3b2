from __future__ import annotations

import hashlib
import random
import re

import pytest

from looptrace.llm import pii


@pytest.fixture(scope="module")
def model():
    return pii.train(pii.written_rows())


def plain(text):
    """The patterns as they are stated, without any care for long texts."""
    found = [("email", *m.span()) for m in re.finditer(
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d))))
                    for i, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
              if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


def test_patterns_against_the_stated_ones():
    draw = random.Random(4)
    for _ in range(20_000):
        text = "".join(draw.choice("ab@@..--+ ()0123456789 94%_é") for _ in range(draw.randrange(60)))
        assert sorted(pii.pattern_spans(text)) == sorted(plain(text)), text
    card = "4111111111111111 4111-1111-1111-1111, 4012888888881881x"
    assert pii.pattern_spans(card) == plain(card) and len(plain(card)) >= 1


@pytest.mark.parametrize("text", ["a" * 300_000 + "@", "1" * 300_000, "1." * 150_000,
                                  "+1" + " " * 300_000, "a@b" * 60_000, "@" * 200_000])
def test_long_runs_take_linear_time(text):
    pii.pattern_spans(text)


def test_the_field_adds_spelt_out_forms(model):
    text = "write to max.muster at web dot example dot com or call (212) 555-0199 today"
    added = pii.added_spans([text], [pii.pattern_spans(text)], model)[0]
    assert {(k, text[a:b]) for k, a, b in added} >= {
        ("email", "max.muster at web dot example dot com"), ("phone", "(212) 555-0199")}


def test_plain_text_gets_no_spans(model):
    for text in ("she was at home and the dot was red", "on 2024-05-17 at 10:45 in version 4.0",
                 "1,299.50 of 12,345 pieces in 1914 or 1918", "the id is 7302918455120935"):
        assert pii.added_spans([text], [[]], model) == [[]], text


def test_viterbi_against_all_paths(model):
    import itertools

    import numpy as np

    row = [t[2] for t in pii.crf.tokens("call 555-01")]
    ids, _ = model.ids([row])
    scores = model.emissions(ids)[0]
    best = max(itertools.product(range(len(model.labels)), repeat=len(row)), key=lambda path: (
        model.begin[path[0]] + sum(scores[t, s] for t, s in enumerate(path))
        + sum(model.move[a, b] for a, b in zip(path, path[1:]))))
    assert np.array_equal(model.decode([row, ["x3"]])[0], best)


def test_rows_of_any_kind(docs, model):
    mail = "ä mail a.b@c.example.org now"
    df = docs((1, mail), (1, mail), (2, None), (3, ""), (None, "+49 30 123456789"),
              (4, "word " * 200_000 + mail))
    out = {(r.doc_id, None if r.text is None else len(r.text)): r for r in pii.find(df, model).collect()}
    one = out[1, len(mail)]
    assert (one.n_email, one.spans) == (1, "email:7:24")
    assert one.base_sha256 == hashlib.sha256(b"email:7:24").hexdigest()
    assert one.redacted == "ä mail <EMAIL> now"
    assert out[2, None].spans == "" and out[2, None].redacted is None
    assert out[3, 0].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert out[None, 16].n_phone == 1
    assert out[4, 1_000_000 + len(mail)].spans == "email:1000007:1000024"
    assert pii.find(df, model).count() == 6
    assert pii.find(docs(), model).collect() == []


def test_overlapping_finds_are_redacted_once():
    text = "x +1 (212) 555-0199 y"
    assert pii.redact(text, [("phone", 2, 19), ("card", 5, 12)]) == "x <PHONE> y"


@pytest.mark.parametrize("form", [
    "bob <at> example.com", "bob{at}example.com", "bob ( at ) example.com",
    "bob [ at ] example [ dot ] com", "bob (at) example (dot) com", "bob@example.com",
    "bob arroba example punto com", "bob at example punkt com", "bob arobase example point com",
    "bob [arobase] example [point] org", "bob (arroba) example.com",
])
def test_each_form_alone_in_a_plain_text(model, form):
    for before, after in (("please write to ", " before noon today"), ("mail ", ", thanks")):
        text = before + form + after
        base = [pii.pattern_spans(text)]
        found = {(k, text[a:b]) for k, a, b in base[0] + pii.added_spans([text], base, model)[0]}
        assert ("email", form) in found, found


def test_cue_words_in_plain_text_give_no_spans(model):
    for text in ("at that point she was at work", "el punto de partida fue la arroba",
                 "der punkt am ende", "le point de vue est au point", "point 3 at 10.5 of the list"):
        assert pii.added_spans([text], [[]], model) == [[]], text


def digits_of_all_sorts():
    import unicodedata

    return [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) in ("No", "Nd")]


def test_signs_that_only_look_like_digits(model):
    signs = digits_of_all_sorts()
    assert len(signs) > 1_000
    texts = ["area 10² call 555 555 0199", *(f"call {s} or {s}7 5{s} 555 555 0142" for s in signs)]
    base = [pii.pattern_spans(t) for t in texts]
    added = pii.added_spans(texts, base, model)
    assert all(t[a:b].strip() for t, spans in zip(texts, added) for _, a, b in spans)


def test_a_part_of_many_zeros_is_a_part(model):
    text = "0" * 5_000 + ".1.1.1"
    assert pii.pattern_spans(text) == [("ip", 0, len(text))]
    assert pii.pattern_spans("9" * 5_000 + ".1.1.1") == []
    assert pii.added_spans([text], [pii.pattern_spans(text)], model) == [[]]


def test_pieces_of_a_batch_change_no_span(model, monkeypatch):
    texts = [t for t, _ in pii.written_rows(seed=3)][:300]
    texts += [" ".join(texts[i : i + 9]) for i in range(0, 60, 9)]
    base = [pii.pattern_spans(t) for t in texts]
    whole = pii.added_spans(texts, base, model)
    assert sum(map(len, whole)) > 50
    monkeypatch.setattr(pii, "TOKENS_AT_ONCE", 40)
    monkeypatch.setattr(pii.crf, "PADDED", 30)
    monkeypatch.setattr(pii.crf, "STEPS", 5)
    assert pii.added_spans(texts, base, model) == whole


def test_a_long_table_of_numbers_stays_small(model):
    import random
    import tracemalloc

    draw = random.Random(1)
    text = " ".join(str(draw.randrange(10 ** draw.randrange(1, 8))) for _ in range(100_000))
    base = pii.pattern_spans(text)
    tracemalloc.start()
    found = pii.added_spans([text, "call 555 555 0199", *["a@b.cc 1 2 3 4567"] * 255],
                            [base, [], *[pii.pattern_spans("a@b.cc 1 2 3 4567")] * 255], model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6 and len(found) == 257


def test_many_finds_in_one_text_take_linear_time(model):
    text = "the host is 10.0.0.1 in the office and please call 555 555 0199 before noon then\n" * 20_000
    base = pii.pattern_spans(text)
    assert len(base) == 20_000
    assert len(pii.added_spans([text], [base], model)[0]) >= 19_000


def test_gradient_steps_raise_the_likelihood_of_the_tags():
    rows = pii.written_rows(seed=5)[::3]
    model = pii.train(rows)
    texts = [t for t, _ in rows]
    found = pii.added_spans(texts, [[] for _ in texts], model)
    right = sum({s for s in spans if pii.holds(s[0], t[s[1] : s[2]])} <= set(got)
                for (t, spans), got in zip(rows, found))
    assert right >= 0.95 * len(rows)
