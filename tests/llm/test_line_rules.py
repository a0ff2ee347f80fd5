from collections import Counter

from helpers import WORD, clashing, documents, odd_rows

from censusloom.llm import line_rules as rules


def brute_repeats(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    return len({i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)})


def test_repeated_windows():
    for text in ("a b c d e a b c d e", "a " * 30, "a b c d", "", "x a b c d e y a b c d e z a b c d", "a b a b a b a b"):
        words = WORD.findall(text)
        assert rules.repeat_words(words) == brute_repeats(words)


def test_rules():
    good = "This is a whole sentence with words."
    for line in ("Home | News | Sport | Contact", "LOUD!! WORDS!! ARE!! HERE!!", "a### b*** c$$$ d%%%.", "no end here",
                 "This site uses our cookie policy."):
        assert rules.line_fails(line, line.split()), line
        found = rules.clean(f"{good}\n{line}")
        assert found.kept_lines == [good]
    assert not rules.line_fails(good, good.split())


def test_boilerplate_in_four_languages():
    for line in ("Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "All rights reserved.",
                 "Haga clic aquí.", "Cliquez ici pour en savoir plus.", "Bitte KLICKEN SIE HIER.", "Siehe Datenschutzerklärung."):
        assert rules.line_fails(line, line.split()), line
    for line in ("Der Herbst war lang.", "Le chat dort ici.", "El aviso llegó tarde.", "He clicked and waited."):
        assert not rules.line_fails(line, line.split()), line


def test_documents_that_lose_too_much():
    good, bad = "One two three four five six seven eight.", "Home | News | Sport | Contact | About | Imprint"
    assert rules.clean(f"Some other words in here, enough of them.\n{good}\n{bad}").kept
    assert not rules.clean(f"{bad}\nOne two three.\nFurther | Links | Around | Here").kept
    assert rules.clean(None).base_failed and rules.clean("").n_words == 0


def test_equal_lines():
    found = rules.clean("A line of text.\n\n\nA line of text.\nA line of text. ")
    assert found.n_dup_lines == 1 and found.n_failed_lines == 1


def test_tables(spark):
    docs = clashing(documents(spark, odd_rows()))
    found = rules.clean_lines(docs)
    assert found.count() == len(odd_rows())
    assert {r.n_words for r in found.where("doc_id IN (3, 4, 6)").collect()} == {0}
    assert rules.clean_lines(docs.limit(0)).count() == 0
