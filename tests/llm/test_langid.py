from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from looptrace.llm import langid

EN = "the quick brown fox jumps over the lazy dog and runs away from the other animals there "
FR = "le renard brun saute par dessus le chien paresseux et part loin de tous les autres animaux "


def brute(texts):
    """Interpolated Kneser-Ney by dictionaries: p(gram) for any gram of ORDER characters."""
    top = Counter()
    for text in texts:
        codes = langid.normal(text).tolist()
        top.update(tuple(codes[i : i + 4]) for i in range(len(codes) - 3))
    counts = {4: top}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    size = len(counts[1])
    off = {}
    for n, c in counts.items():
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        off[n] = ones / (ones + 2 * twos) if ones and twos else 0.5
    totals, kinds = defaultdict(int), defaultdict(int)
    for n, c in counts.items():
        for g, v in c.items():
            totals[g[:-1]] += v
            kinds[g[:-1]] += 1

    def p(gram):
        if not gram:
            return 1 / (size + 1)
        n = len(gram)
        below = p(gram[1:])
        if not totals[gram[:-1]]:
            return below
        own = max(counts[n][gram] - off[n], 0) if counts[n][gram] else 0
        return own / totals[gram[:-1]] + off[n] * kinds[gram[:-1]] / totals[gram[:-1]] * below

    return p


def counted(texts):
    packed = np.concatenate([langid.grams(langid.normal(t)) for t in texts])
    return np.unique(packed, return_counts=True)


def test_against_dictionaries():
    model = langid.kneser_ney({"en": counted([EN, EN[:20]])})
    p = brute([EN, EN[:20]])
    for text in (EN, FR, "zq", "the dog"):
        codes = langid.normal(text).tolist()
        logs = [math.log(p(tuple(codes[i : i + 4]))) for i in range(len(codes) - 3)]
        n, nats = model.entropies([text])
        assert n[0] == len(logs)
        assert nats[0, 0] == pytest.approx(-sum(logs) / len(logs), rel=1e-4)


def test_probabilities_sum_to_one():
    p = brute([EN])
    seen = {c for t in (EN,) for c in langid.normal(t).tolist()}
    codes = tuple(langid.normal("the ").tolist()[:3])
    assert sum(p((*codes, c)) for c in seen) + p((*codes, 9999)) == pytest.approx(1)


def test_normal_form():
    text = lambda t: "".join(map(chr, langid.normal(t)))
    assert text("  It's 5 O'CLOCK!!") == " it s o clock "
    assert text("12 ... !") == text("") == ""
    assert text("a") == " a  "


def test_held_out_accuracy(spark, given):
    table = spark.read.parquet(f"{given}/documents.parquet").where("lang IS NOT NULL")
    model = langid.train(table.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    held = langid.predict(table.where("crc32(cast(doc_id as string)) % 4 = 2"), model).collect()
    right = sum(r.lang == r.lang_pred for r in held)
    assert right >= 0.97 * len(held) and not any(r.rejected for r in held)


def test_rows_of_any_kind(docs):
    labelled = docs(*[(i, (EN if i % 2 else FR)[i % 7 :], "en" if i % 2 else "fr")
                      for i in range(60)], (70, None, "en"), (71, EN, None), (72, "", "de"))
    model = langid.train(labelled)
    df = docs((1, EN), (1, EN), (2, FR.upper()), (3, None), (4, ""), (5, "12 !"), (None, FR),
              (6, "слова совсем другого языка " * 30), (7, EN * 5000))
    out = langid.predict(df, model).collect()
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in out]
    assert sorted(got, key=str) == sorted([
        (1, "en", False), (1, "en", False), (2, "fr", False), (3, "und", True), (4, "und", True),
        (5, "und", True), (None, "fr", False), (7, "en", False),
        next(g for g in got if g[0] == 6)], key=str)
    assert next(g for g in got if g[0] == 6)[2]
    assert all(0 <= r.score <= 1 for r in out)
    assert langid.predict(docs(), model).collect() == []


def test_every_language_is_learned(docs):
    rows = [(i, f"{chr(97 + i) * 3} {chr(98 + i) * 4} " * 5, f"l{i}") for i in range(20)]
    model = langid.train(docs(*rows))
    assert sorted(model.languages) == sorted(r[2] for r in rows)
    out = langid.predict(docs(*rows), model).collect()
    assert all(r.lang == r.lang_pred for r in out)


def test_nothing_to_learn_from(docs):
    assert langid.train(docs((1, EN, None), (2, None, "en"))) is None
    assert [r.lang_pred for r in langid.predict(docs((1, EN)), None).collect()] == ["und"]


def test_equal_models_go_by_name():
    model = langid.kneser_ney({"b": counted([EN]), "a": counted([EN])})
    langid.calibrate(model, [EN], ["a"])
    assert model.languages[model.judge([EN])[0][0]] == "a"


def test_copies_and_long_texts_are_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "kneser_ney", lambda c, f=langid.kneser_ney: seen.append(c) or f(c))
    rng = np.random.default_rng(5)
    for word in ("renard", "chien", "brun"):  # other hashes each time
        copied = (FR + word + " ") * 20
        rows = [(copied, "fr")] * 400 + [(EN * 25 + str(i) + "x" * (i % 9), "en") for i in range(40)]
        for i in range(3):
            words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(50)]
            rows.append((" ".join(rng.choice(words, 40_000)), "xx"))
        model = langid.train(spark.createDataFrame(rows, "text string, lang string"), max_chars=20_000)
        assert model.languages == ["en", "fr", "xx"]
        one = langid.grams(langid.normal(copied))
        assert seen[-1]["fr"][1].sum() == len(one)  # once, not 400 times
        assert seen[-1]["xx"][1].sum() <= 3.1 * langid.WINDOW * langid.WINDOWS
        assert seen[-1]["en"][1].sum() <= 60_000


def test_share_of_the_hashes():
    assert langid.share([(0, 10, 0.6), (1, 10, 0.3)], 30) == 1.0
    assert langid.share([(0, 100, 0.6), (1, 50, 0.3)], 100) == 0.75
    assert langid.share([(0, 4000, 0.8)], 10) == 0.8


def test_a_few_wrong_labels_leave_the_limit():
    words = {"en": EN.split(), "fr": FR.split()}
    rng = np.random.default_rng(1)
    text = lambda k, n=60: " ".join(rng.choice(words[k], n))
    model = langid.kneser_ney({k: counted([text(k) for _ in range(40)]) for k in words})
    known = [(text(k), k) for k in ("en", "fr") for _ in range(100)]
    foreign = "слова совсем другого языка " * 8
    wrong = [(text("en"), "fr"), (text("fr"), "en"), (foreign, "en"), ("qzj xkw vvq " * 10, "fr")]
    langid.calibrate(model, *zip(*known))
    limit = model.limit
    langid.calibrate(model, *zip(*(known + wrong)))
    assert model.limit <= 1.1 * limit
    assert model.judge([foreign])[3][0] and not any(model.judge([t for t, _ in known])[3])


def size_of(model):
    levels = [*model.probabilities, *model.backoffs]
    return sum(x.nbytes for v in levels for x in (v.hashes, v.starts, v.languages, v.logs))


def test_the_models_grow_with_what_languages_have():
    draw = np.random.default_rng(3)

    def models(n):
        out = {}
        for i in range(n):
            codes = draw.integers(1_000 + 90 * i, 1_090 + 90 * i, 20_000).astype(np.uint16)
            out[f"l{i:02}"] = np.unique(langid.grams(codes), return_counts=True)
        return langid.kneser_ney(out)

    small, large = size_of(models(20)), size_of(models(40))
    assert 1.8 < large / small < 2.2 and large < 60e6


def test_languages_that_lack_a_gram_back_off_alone():
    model = langid.kneser_ney({"en": counted([EN]), "fr": counted([FR]), "x": counted(["qq qq qqq"])})
    floor = math.log(len({c for t in (EN, FR, "qq") for c in langid.normal(t).tolist()}) + 1)
    for name, texts in (("en", [EN]), ("fr", [FR]), ("x", ["qq qq qqq"])):
        alone = langid.kneser_ney({name: counted(texts)})
        alone.floor = -floor
        k = model.languages.index(name)
        for text in (EN, FR, "qqq zz the"):
            packed = langid.grams(langid.normal(text))
            p = np.exp(model.logs(packed)[:, k].astype(float))
            assert (p > 0).all() and (p <= 1).all()
            size = len({c for t in texts for c in langid.normal(t).tolist()})
            if math.isclose(floor, math.log(size + 1)):
                assert np.allclose(p, np.exp(alone.logs(packed)[:, 0]), rtol=1e-4)


def test_pieces_of_long_texts_change_nothing(monkeypatch):
    model = langid.kneser_ney({"en": counted([EN]), "fr": counted([FR])})
    texts = [EN, "", FR * 30, "12", EN[:7], FR]
    sizes, nats = model.entropies(texts)
    monkeypatch.setattr(langid, "CELLS", 26)
    again = model.entropies(texts)
    assert (again[0] == sizes).all() and np.allclose(again[1], nats, rtol=1e-6)


def test_a_thousand_junk_labels(spark, monkeypatch):
    draw = np.random.default_rng(7)
    junk = [("".join(draw.choice(list("abcdefghij "), 60)), f"junk{i}") for i in range(1_000)]
    good = [(" ".join(draw.choice(w.split(), 60)), k) for k, w in (("en", EN), ("fr", FR)) for _ in range(60)]
    df = spark.createDataFrame(junk + good, "text string, lang string")
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 400)
    model = langid.train(df)
    assert len(model.languages) == 400 and {"en", "fr"} <= set(model.languages)
    assert size_of(model) < 20e6
    assert [model.languages[b] for b in model.judge([EN, FR])[0]] == ["en", "fr"]


@pytest.mark.parametrize("copies", [1, 60])
def test_calibration_is_from_unseen_texts_at_every_size(spark, monkeypatch, copies):
    learned, checked = [], []
    monkeypatch.setattr(langid, "kneser_ney", lambda c, f=langid.kneser_ney: learned.append(c) or f(c))
    monkeypatch.setattr(langid, "calibrate", lambda m, t, x, f=langid.calibrate: checked.append(t) or f(m, t, x))
    draw = np.random.default_rng(copies)
    rows = [(" ".join(draw.choice(w.split(), 30)), k) for k, w in (("en", EN), ("fr", FR))
            for _ in range(80 * copies)]
    langid.train(spark.createDataFrame(rows, "text string, lang string"))
    part, whole = learned
    held = sum(len(langid.normal(t)) - 3 for t in checked[0])
    total = [sum(n.sum() for _, n in c.values()) for c in (part, whole)]
    assert checked[0] and total[1] > total[0]
    if copies == 1:
        assert total[1] - total[0] == held
