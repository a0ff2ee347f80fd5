import random
import string
from collections import Counter

import numpy as np
import pytest
from helpers import SF, clashing, documents, odd_rows, parquet_rows

from censusloom.llm import kneser_ney as kn
from censusloom.llm.queries import QUERIES


def counts_of(texts):
    grams = Counter()
    for text in texts:
        for word in kn.words_of(text):
            padded = kn._PAD * (kn.ORDER - 1) + word + kn._END
            grams.update(padded[i : i + kn.ORDER] for i in range(len(padded) - kn.ORDER + 1))
    return grams


EN = ["the cat sat on the mat and the dog ran", "that thing there"]
DE = ["der hund und die katze", "das ist ein schöner tag über"]


def model():
    return kn.fit({"de": counts_of(DE), "en": counts_of(EN)}, ["de", "en"])


def test_probabilities_sum_to_one():
    fitted = model()
    alphabet = sorted({g[-1] for texts in (EN, DE) for g in counts_of(texts)})
    for context in (kn._PAD * 3, "the", "und", "xyz", kn._PAD * 2 + "t"):
        unseen = kn._codes([context + c for c in [*alphabet, "\u4e2d"]])
        assert np.allclose(np.exp(fitted.log_probability(unseen)).sum(axis=0), 1)


def brute(grams, gram):
    """Interpolated Kneser-Ney by its definition."""
    levels = {kn.ORDER: grams}
    for size in range(kn.ORDER - 1, 0, -1):
        levels[size] = Counter(g[1:] for g in levels[size + 1])
    alphabet = len({g for c in (counts_of(EN), counts_of(DE)) for g in (x[-1] for x in c)}) + 1

    def p(size):
        part, level = gram[kn.ORDER - size :], levels[size]
        ones, twos = (sum(n == k for n in level.values()) for k in (1, 2))
        discount = max(kn.DISCOUNT_FLOOR, ones / (ones + 2 * twos))
        total = sum(n for g, n in level.items() if g[:-1] == part[:-1])
        kinds = sum(g[:-1] == part[:-1] for g in level)
        below = p(size - 1) if size > 1 else 1 / alphabet
        if not total:
            return below
        return max(level[part] - discount, 0) / total + discount * kinds / total * below

    return p(kn.ORDER)


def test_equals_the_definition():
    fitted = model()
    grams = ["the ".strip() + "r", "that", "und" + kn._END, kn._PAD * 3 + "d", "zzzz", "schö", "atxx", "über"]
    grams = [g for g in grams if len(g) == kn.ORDER]
    found = np.exp(fitted.log_probability(kn._codes(grams)))
    for row, gram in enumerate(grams):
        assert abs(found[row, 0] - brute(counts_of(DE), gram)) < 1e-9, gram
        assert abs(found[row, 1] - brute(counts_of(EN), gram)) < 1e-9, gram


def test_words_are_scored_symbol_by_symbol():
    fitted = model()
    for word in ("the", "x", "überhaupt"):
        padded = kn._PAD * (kn.ORDER - 1) + word + kn._END
        grams = [padded[i : i + kn.ORDER] for i in range(len(word) + 1)]
        expected = fitted.log_probability(kn._codes(grams)).sum(axis=0)
        assert np.allclose(fitted.word_logs(["a", word, "b"])[1], expected)


def test_small_memo_changes_nothing():
    fitted = model()
    texts = [*EN, *DE, None, "", "123 !!", "the the the"]
    large, small = kn._Scorer(fitted), kn._Scorer(fitted, numbers=12)
    assert np.allclose(large(texts)[0], np.vstack([small([t])[0] for t in texts]))


def test_letters():
    assert kn.words_of("12 ²½ !? ́") == [] and kn.words_of(None) == []
    assert kn.words_of("Don't stop2go") == ["don", "t", "stop", "go"]


def test_query_accuracy(spark):
    found = QUERIES["op10_kneser_ney"](spark, SF).collect()
    langs = dict(parquet_rows("documents", "doc_id, lang"))
    held = [r for r in found if r.held_out]
    assert len(found) == len(langs) and len(held) > 40
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    assert sum(r.rejected for r in found) == 0


def test_tables_and_rejection(spark):
    rows = [(i, t, lang, "s", 1) for i, t, lang in parquet_rows("documents", "doc_id, text, lang")]
    extra = [
        (1000, "Съешь же ещё этих мягких французских булок да выпей чаю " * 5, None, "s", 1),
        (1001, "12345 !!", "en", "s", 1), (1002, None, "en", "s", 1), (1003, "", None, None, None),
        (None, rows[0][1], "en", "s", 1), (1004, rows[0][1], None, "s", 1), (1004, rows[0][1], None, "s", 1),
    ]
    docs = clashing(documents(spark, rows + extra))
    found = kn.predict_languages(docs)
    assert found.count() == len(rows) + len(extra)
    by_id = {r.doc_id: r for r in found.collect()}
    assert [by_id[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3
    assert all(by_id[i].rejected for i in (1000, 1001, 1002, 1003)) and not by_id[1004].rejected
    kept = kn.in_known_languages(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 3


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(i, "some words", None, "s", 1) for i in range(5)])
    assert {r.lang_pred for r in kn.predict_languages(docs).collect()} == {"und"}
    assert kn.predict_languages(docs.limit(0)).count() == 0
    assert kn.predict_languages(documents(spark, odd_rows())).count() == len(odd_rows())


DUTCH = (
    "Het oude huis aan de gracht werd vorig jaar door een jong gezin gekocht en zorgvuldig opgeknapt. "
    "Tegenwoordig zitten zij elke zondag buiten en kijken naar de schepen die langzaam voorbij varen. "
)


def garbage(seed, words=30):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(string.ascii_lowercase, k=draw.randint(3, 9))) for _ in range(words))


def test_garbage_labels_do_not_raise_the_limit(spark):
    rows = [(i, t, lang, "s", 1) for i, t, lang in parquet_rows("documents", "doc_id, text, lang")]
    docs = documents(spark, rows + [(5000 + i, garbage(i), "en", "s", 1) for i in range(4)])
    model = kn.train(docs, documents_per_language=40)
    asked = [(1, DUTCH * 5, None, "s", 1), (2, garbage(99, 300), None, "s", 1), (3, rows[0][1], None, "s", 1)]
    found = {r.doc_id: r.rejected for r in kn.identify(documents(spark, asked), model).collect()}
    assert found == {1: True, 2: True, 3: False}
    kept = kn.identify(documents(spark, rows), model).where("NOT rejected").count()
    assert kept == len(rows)


def test_limit_without_held_back_rows(spark):
    rows = [(i, t, "en", "s", 1) for i, t, lang in parquet_rows("documents", "doc_id, text, lang") if lang == "en"]
    model = kn.train(documents(spark, rows[:4]))
    asked = [(1, "Съешь же ещё этих мягких французских булок да выпей чаю " * 20, None, "s", 1), (2, rows[9][1], None, "s", 1)]
    found = {r.doc_id: r.rejected for r in kn.identify(documents(spark, asked), model).collect()}
    assert found == {1: True, 2: False}


def test_repeated_rows_and_ids_take_one_place(spark, monkeypatch):
    counted = []
    original = kn._gram_counts
    monkeypatch.setattr(kn, "_gram_counts", lambda sample: (counted.append(sample.collect()), original(sample))[1])
    texts = sorted({t for t, lang in parquet_rows("documents", "text, lang") if lang == "en"})[:60]
    repeated = [(i, t, "en", "s", 1) for i, t in enumerate(texts) for _ in range(40)]
    blank = [(10_000 + i, "12 !?" if i % 2 else None, "en", "s", 1) for i in range(400)]
    one_id = [(77, f"{t} {i}", "de", "s", 1) for i, t in enumerate(texts * 3)]
    kn.train(documents(spark, repeated + blank + one_id), documents_per_language=20)
    sampled = Counter(r.lang for r in counted[0])
    assert sampled == {"en": 16, "de": 16}
    assert len({r.text for r in counted[0] if r.lang == "en"}) == 16


def test_a_hundred_languages(spark, monkeypatch):
    """Languages of different letters: all are told apart, and a limit on the models' size holds."""
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 1200)]
    rows = []
    for lang in range(100):
        for i in range(6):
            draw = random.Random(lang * 100 + i)
            text = " ".join("".join(draw.choices(letters[lang * 12 : lang * 12 + 12], k=4)) for _ in range(40))
            rows.append((lang * 6 + i, text, f"l{lang:02d}", "s", 1))
    found = kn.predict_languages(documents(spark, rows)).collect()
    assert sum(r.lang_pred == rows[r.doc_id][2] for r in found) >= 0.97 * len(rows)
    monkeypatch.setattr(kn, "MAX_MODEL_MB", 0.1)
    with pytest.raises(ValueError, match="documents_per_language"):
        kn.train(documents(spark, rows))


def test_texts_are_scored_once(spark, monkeypatch):
    scored = []
    plain = kn._scored
    monkeypatch.setattr(kn, "_scored", lambda *args: scored.append(args[3]) or plain(*args))
    rows = [(i, t, lang, "s", 1) for i, t, lang in parquet_rows("documents", "doc_id, text, lang")]
    docs = documents(spark, rows)
    assert kn.predict_languages(docs).count() == len(rows) and len(scored) == 1
    assert kn.in_known_languages(docs).count() == len(rows) and len(scored) == 2
