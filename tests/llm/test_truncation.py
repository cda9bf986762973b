from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.truncation import clean_tail, judge, keys_of, places, plain, tail_of, tally, trie, vocabulary

PLACES = [a + b for a in ("Amsel", "Biber", "Dachs", "Erlen", "Falken", "Hecht") for b in ("bach", "berg", "feld", "furt", "rode", "stein")]
SENTENCES = [
    "Die Verwaltung berichtet über den Sachstand zur Brücke an der {p}.", "Zeugen melden sich bitte bei der Wache in {p}.", "Der Eintritt kostet {n} Euro, ermäßigt {m} Euro.",
    "Wegen Arbeiten an der Fahrbahn kommt es am {n}. Mai zu Behinderungen.", "Die Straße war für {n} Stunden gesperrt.", "Unbekannte entwendeten mehrere Fahrräder aus einem Keller in {p}.",
]


def corpus(n=1500, seed=3):
    r = random.Random(seed)
    docs, cut = [], set()
    for i in range(n):
        src = ("limit", "free", "titles")[i % 3]
        if src == "titles" and r.random() < 0.5:
            docs.append((i, src, f"Zeugen gesucht nach Unfall in {r.choice(PLACES)}"))
            continue
        text = " ".join(r.choice(SENTENCES).format(p=r.choice(PLACES), n=r.randrange(2, 29), m=r.randrange(2, 9)) for _ in range(r.randrange(2, 9)))
        full = text
        if src == "limit":
            text = text[:200]
        elif r.random() < 0.2:
            at = r.randrange(40, len(text) - 3)
            text = text[:at] + r.choice(["", "", "</", " …", "\n"])
        elif r.random() < 0.2:
            text += r.choice(["\nStand: 01.02.2024", "\n#Amselbach #Biberfeld", " </p>", "\n\nPressestelle Amselbach"])
        shown = clean_tail(text)[0]
        if shown != clean_tail(full)[0] and len(shown) < len(full) and not shown.endswith((".", "!")) and not text.endswith(("2024", "#Biberfeld", "Amselbach")):
            cut.add(i)
        docs.append((i, src, text))
    return docs, cut


@pytest.fixture(scope="module")
def judged(spark):
    docs, cut = corpus()
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, source string, text string, last int")
    return {r["doc_id"]: r for r in judge(df).collect()}, docs, cut


def test_found(judged):
    rows, docs, cut = judged
    assert len(rows) == len(docs)
    got = {i for i, r in rows.items() if r["truncated"]}
    assert len(got & cut) >= 0.93 * len(cut)
    assert len(got & cut) >= 0.93 * len(got)


def test_titles_are_whole(judged):
    rows, docs, _ = judged
    titles = [i for i, s, t in docs if s == "titles" and t.startswith("Zeugen gesucht")]
    assert sum(rows[i]["truncated"] for i in titles) <= 0.02 * len(titles)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", ""), (3, "a", "  \n"), (4, "a", "wort " * 60_000), (4, "a", "x"), (None, "a", "Ein Satz.")], "doc_id bigint, source string, text string")
    rows = judge(df).collect()
    assert len(rows) == 6
    assert not any(r["truncated"] for r in rows if r["doc_id"] in (1, 2, 3, None))
    assert judge(df.limit(0)).count() == 0


def test_tail_marks():
    assert clean_tail("Zu Fuß und mit [...]") == ("Zu Fuß und mit", True, False)
    assert clean_tail("bleibt frei. (mehr) ") == ("bleibt frei.", True, False)
    assert clean_tail("abkam.</p></div>") == ("abkam.", False, False)
    assert clean_tail("Ursache v<p")[::2] == ("Ursache v", True)
    assert clean_tail("vor &uu") == ("vor", False, True)


def test_tally_counts_the_contexts_of_the_places():
    docs, _ = corpus(300, 9)
    texts = [t for _, _, t in docs] + ["3. Mai 5. ", "a.b.c", "1.", "Am 3. Mai 2024 um 8.30 Uhr! Ja? (nein) „so“", "\n\n- X\n- Y: z\n", "", "Wort", "x " * 40]
    common = frozenset("Die Der Mai am der Straße war Euro".split())
    for t in texts:
        got: dict = {}
        tally(t, common, got)
        want: dict = {}
        for sentence, line, _, what in places(t, common):
            if what != "eot":
                for k in keys_of(sentence, line):
                    if k is not None:
                        want.setdefault(k, [0, 0])[what == "on"] += 1
        assert got == want, t


def test_trie(spark):
    w = vocabulary(spark.createDataFrame([("Abend Abendkasse am Abend",), ("Abendkasse am",)], "text string"))
    t = {r["prefix"]: r["below"] for r in trie(w, F.lit(False)).collect()}
    assert t["A"] == 2 and t["Abend"] == 1 and "Abendkasse" not in t


def test_tails_of_padded_ends(spark):
    """Padding, long tags and entities before the end leave its contexts those of the whole text."""
    from tessera.llm.truncation import CONTEXTS, plain, tails

    start = "Die Verwaltung berichtet dem Ausschuss über den Sachstand zur Brücke am Bach und die Kosten der Sperrung"
    fill = [" " * 3000, f' <a href="{"x" * 150}"> ' * 30, "&nbsp;" * 700 + " ", " " + "y" * 2500 + " ", "\n" + " " * 1500, " " * 990]
    texts = [f"{start}{f}für die Stadt" for f in fill]
    got = {r["doc_id"]: tuple(r[c] for c in CONTEXTS) for r in tails(spark.createDataFrame(list(enumerate(["s"] * len(texts))), "doc_id long, source string").join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id"), frozenset()).collect()}
    for i, text in enumerate(texts):
        for sentence, line, _, _ in places(plain(text), frozenset()):
            last = keys_of(list(sentence), line)
        assert got[i] == tuple(last), i


def test_signs_that_are_no_markup():
    assert clean_tail("mehr als R&D") == ("mehr als R&D", False, False)
    assert clean_tail("von AT&T") == ("von AT&T", False, False)
    assert clean_tail("Vergleich a < b und dann") == ("Vergleich a < b und dann", False, False)
    assert plain("a < b und c > d") == "a < b und c > d"


def test_markup_of_any_length():
    link = '<a href="https://example.org/' + "x" * 500 + '">'
    assert clean_tail(f"Der Weg ist frei.{link}</a>") == ("Der Weg ist frei.", False, False)
    assert clean_tail("Der Weg ist" + link[:-2]) == ("Der Weg ist", False, True)
    assert plain(f"Ein{link}Wort") == "Ein Wort"


def test_ends_with_words_and_tags_longer_than_the_window():
    """The end gives the contexts of the whole text, however long its last words and tags are."""
    common = frozenset("der weg ist".split())
    for text in ("Der Weg ist " * 3 + "y" * 1100, "Erste Zeile\nder weg " + "z" * 2500 + " ist", "der " + "q" * 900 + " weg " + "r" * 900 + " ist", "der <b class='" + "k" * 3000 + "'> weg ist"):
        whole = [keys_of(list(s), line) for s, line, _, _ in places(plain(text), common)][-1]
        assert [keys_of(list(s), line) for s, line, _, _ in places(tail_of(text), common)][-1] == whole


def test_long_words(spark):
    """A cut word of more letters than most words have is found too."""
    long = "donaudampf" * 12
    texts = [(i, "s", f"Hier steht {long} im Text.") for i in range(6)] + [(9, "s", f"Hier steht {long[:90]}")]
    rows = {r["doc_id"]: r["truncated"] for r in judge(spark.createDataFrame(texts, "doc_id long, source string, text string")).collect()}
    assert rows[9] and not any(rows[i] for i in range(6))
