from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from tessera.functions import scalars, text
from tessera.operators.linking import link_confidence


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


def test_normalise_and_similarity(spark):
    assert one(spark, "  Große  Straße Ä ", text.normalize) == "grosse strasse ä"
    assert one(spark, None, text.normalize) == ""
    assert round(one(spark, "word", lambda c: text.similarity(c, F.lit("two words"))), 6) == 0.363636
    assert one(spark, "", lambda c: text.similarity(c, F.lit(""))) == 0
    assert one(spark, "über-Ölweg", lambda c: text.similarity(c, F.lit("ÜBER ölweg"))) == 1


def test_markup_and_classes(spark):
    assert one(spark, "<p>a <b>b</b></p> ", text.strip_html) == "a b" and one(spark, "<br>", text.strip_html) is None
    assert one(spark, "a<br/>b</P>c &amp; d", text.html_to_text) == "a\nb\nc & d"
    assert one(spark, "Unfall mit Aufzug", lambda c: text.classify_report(c, F.lit(None))) == "demonstration"
    assert one(spark, None, lambda c: text.classify_report(c, F.lit("nichts"))) == "police_report"


def test_mentions_match_the_alternation(spark):
    """Against the longest-first alternation with word boundaries that the matcher stands for."""
    terms = [("innenstadt", "1"), ("innenstadt-nord", "2"), ("brechten", "3"), ("brechtener strasse", "4"), ("eving", "5"), ("am see", "6")]
    texts = ["Innenstadt-Nord und Innenstadt", "süeving, Eving. EVING!", "Brechtener  Straße in Brechten", "am See am seeufer", "", None, "brechten-eving " * 500]
    g = spark.createDataFrame([(t, i, "mentions_area") for t, i in terms], "term string, node_id string, relation string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    pattern = re.compile(r"(?<!\w)(" + "|".join(re.escape(t) for t, _ in sorted(terms, key=lambda x: -len(x[0]))) + r")(?!\w)")
    want = {(i, m) for i, t in enumerate(texts) for m in pattern.findall(re.sub(r"\s+", " ", (t or "").lower().replace("ß", "ss")))}
    assert {(r["id"], r["term"]) for r in text.mentions(df, g).collect()} == want
    assert text.mentions(df, g.limit(0)).count() == 0


def test_gazetteer_layers(spark):
    layer = lambda rows: spark.createDataFrame(rows, "ord int, id string, label string")
    g = text.gazetteer([(layer([(1, "a", "Hombruch"), (2, "b", "HOMBRUCH"), (3, "c", "Ost")]), "area"), (layer([(1, "d", "Kreuzstraße"), (2, "e", "Kreuzstrasse"), (3, "f", "hombruch")]), "street")])
    assert {tuple(r) for r in g.collect()} == {("hombruch", "f", "street"), ("kreuzstrasse", "e", "street")}


def test_link_confidence(spark):
    f = spark.createDataFrame([("1", "mentions_area"), ("2", "mentions_area"), ("2", "mentions_street"), ("3", "mentions_street")], "id string, relation string")
    assert sorted((r["id"], r["confidence"]) for r in link_confidence(f).collect()) == [("1", 0.85), ("2", 0.7), ("2", 0.9), ("3", 0.9)]


def test_node_text(spark):
    props = json.dumps({"gremium": "Rat", "title": ["no"], "description": "Text", "reason": 5, "other": "x"})
    assert one(spark, props, lambda c: text.node_text(F.lit("L"), c)) == "L Rat Text"


def test_minutes(spark):
    html = "<p>1 Er&ouml;ffnung</p><p>2.1 Haushalt<br>Drucksache Nr.: 12345-24 wird einstimmig beschlossen. Danach abgelehnt.</p><p>Dr. Nr. 22222-24 wird abgelehnt.</p><p>3 Ende Drucksache Nr. 33333-24 vertagt</p>"
    a = one(spark, one(spark, html, text.html_to_text), text.parse_minutes)
    assert [(i["number"], i["title"].split()[0]) for i in a] == [("1", "Eröffnung"), ("2.1", "Haushalt"), ("3", "Ende")]
    assert [(p["nr"], p["vote"], p["passed"]) for i in a for p in i["papers"]] == [("12345-24", "einstimmig", True), ("22222-24", "abgelehnt", False), ("33333-24", None, None)]
    assert one(spark, None, text.parse_minutes) == [] and one(spark, "", text.parse_minutes) == []
    # The first outcome that is said of a paper counts, wherever; papers before the first item belong to none.
    a = one(spark, "Dr. Nr. 11111-24 vertagt\n1 Erstes Dr. Nr. 11111-24 genehmigt, Dr. Nr. 11111-24 abgelehnt\n1.2.3.4.5 kein TOP\n12345678901 keine Nummer\n2 " + "x" * 300, text.parse_minutes)
    assert [(i["number"], len(i["title"]), [tuple(p) for p in i["papers"]]) for i in a] == [("1", 61, [("11111-24", "genehmigt", True)]), ("2", 200, [])]


def test_insights_and_titles(spark):
    i = {"title": "t", "confidence": 0.9}
    for raw, n in ((json.dumps([i, 5]), 1), (json.dumps({"insights": [i, i]}), 2), ("```json\n" + json.dumps([i]) + "\n```", 1), ("Sure: " + json.dumps({"insights": [i]}) + " done", 1), ("garbage", 0), ("", 0), (None, 0), ("5", 0)):
        assert len(one(spark, raw, text.parse_insights)) == n, raw
    assert one(spark, "", lambda c: text.derive_title(c, F.lit("First one. Second."))) == "First one"
    assert one(spark, None, lambda c: text.derive_title(c, F.lit(None))) == "Insight"


def test_scalars(spark):
    assert one(spark, "26,3", scalars.decimal_comma) == 26.3 and one(spark, "<7", scalars.decimal_comma) is None and one(spark, "--", scalars.decimal_comma) is None
    at = lambda c: scalars.date_and_clock(F.lit("31.12.2024"), c).cast("string")
    assert one(spark, "24:00", at) == "2025-01-01 00:00:00" and one(spark, "07:30", at) == "2024-12-31 07:30:00" and one(spark, "25:00", at) is None
    assert one(spark, "2027-06-12T10:00:00.000000+0200", lambda c: scalars.iso_time(c).cast("string")) == "2027-06-12 08:00:00"
    for bad in ("2024-02-28T25:00:00", "2024-02-28 nonsense", "2024-02-30", "bald", "", None):
        assert one(spark, bad, lambda c: scalars.iso_time(c).cast("string")) is None, bad
    assert one(spark, "2024-02-28 nonsense", lambda c: scalars.iso_time_or_date(c).cast("string")) == "2024-02-28 00:00:00"
    assert one(spark, "Tue, 24 Oct 2023 03:35:50 +0200", lambda c: scalars.rfc_time(c).cast("string")) == "2023-10-24 01:35:50"
    assert one(spark, 0, scalars.epoch_time, "long") is None
    assert one(spark, 226, lambda c: scalars.share_pct(c, F.lit(1000)), "int") == 22.6 and one(spark, 0, lambda c: scalars.share_pct(c, F.lit(0)), "int") is None
    key = lambda ids: one(spark, ids, lambda c: scalars.candidate_key(F.lit("t"), c), "array<string>")
    assert key(["a", "b"]) == key(["b", "a"]) != key(["a"]) and len(key(["a"])) == 32
    assert one(spark, "https://x.y/?a=1&documentId=ab%20", lambda c: scalars.url_parameter(c, "documentId")) is not None
    assert one(spark, "<a>\n<b x='1'> t </b></a>", lambda c: scalars.first_tag(c, "b")) == "t"
