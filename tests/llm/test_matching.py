from __future__ import annotations

from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import matching as m
from tessera.llm.naming import Speller, distance, learn, minhash

ODS = "source_id string, _dataset string, _poi_type string, geo_point_2d struct<lon:double,lat:double>, objektart string, objektname string, strasse string, hausnummer string, kind string"
OSM = "source_id string, type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>, label string, addr_street string, addr_housenumber string, fetched_at timestamp, core string"
T = datetime(2025, 1, 1)
SYL = ["Amsel", "Biber", "Dachs", "Eiche", "Falke", "Hecht", "Kirsch", "Linde", "Mohn", "Nuss", "Otter", "Rosen", "Silber", "Tanne", "Ulme", "Weide"]
END = ["bach", "berg", "feld", "furt", "hang", "heide", "hof", "kamp", "moor", "rain", "see", "steg", "tal", "wald", "wiese", "winkel"]


def world(n=256):
    """Places that both sources know, written differently; decoys of another kind at the same spot; places of one source alone."""
    ods, osm, truth = [], [], set()
    for i in range(n):
        stem, street = SYL[i % 16] + END[i // 16 % 16], SYL[(i * 7 + 3) % 16] + END[(i * 5 + 1) % 16]
        lat, lon = 51 + (i % 16) * 0.03, 7 + (i // 16) * 0.05
        kind, tag = (("Grundschule", {"amenity": "school"}), ("Turnhalle", {"leisure": "sports_hall"}), ("Festplatz", {"leisure": "fairground"}))[i % 3]
        name = f"{kind} Am {stem}"
        both = i % 4 != 0
        written = [name, name.upper(), f"Städt. {name}", f"Am {stem}, {kind}", name.replace("e", "ee", 1)][i % 5]
        ods.append((f"o{i:04d}", "d", "t", None if i % 17 == 0 else (lon, lat), kind if i % 6 else None, written, [f"{street}straße", f"{street}str.", f"{street}strasse {i % 90 + 1}"][i % 3], None if i % 3 == 2 else str(i % 90 + 1), "x"))
        if both:
            osm.append((f"node/{i}", "node", i, lat + 0.0002, lon + 0.0002, None, {**tag, "name": name}, name, f"{street}straße", str(i % 90 + 1), T, "x"))
            truth.add((f"o{i:04d}", f"node/{i}"))
        if i % 5 == 0:
            other = "Jugendtreff Am " + stem
            osm.append((f"way/{i}", "way", i, None, None, (lat, lon), {"amenity": "youth_centre", "name": other}, other, f"{street}straße", str(i % 90 + 3), T, "x"))
    return ods, osm, truth


@pytest.fixture(scope="module")
def matched(spark):
    ods, osm, truth = world()
    o, p = spark.createDataFrame(ods, ODS), spark.createDataFrame([*osm, *osm[:40]], OSM)
    rows = m.match(o.union(o.limit(30)), p).collect()
    return rows, truth


def test_precision_and_recall(matched):
    rows, truth = matched
    got = {(r["ods_source_id"], r["osm_source_id"]) for r in rows if r["confidence"] >= m.MATCH}
    assert len(got & truth) >= 0.95 * len(truth)
    assert len(got & truth) >= 0.95 * len(got)


def test_confidence_is_a_probability(matched):
    rows, truth = matched
    assert all(0 <= r["confidence"] <= 1 for r in rows)
    said = sum(r["confidence"] for r in rows)
    true = sum((r["ods_source_id"], r["osm_source_id"]) in truth for r in rows)
    assert abs(said - true) <= 0.1 * len(rows)
    assert len({(r["ods_source_id"], r["osm_source_id"]) for r in rows}) == len(rows)


def test_unseen_vocabulary(spark):
    """Kinds and abbreviations that no list could hold are learnt from the tables."""
    ods, osm, truth = world()
    words = {"Grundschule": "Zorblax", "Turnhalle": "Quimfeld", "Festplatz": "Wexhaus", "Jugendtreff": "Drumlor", "Städt.": "Okk"}
    tags = {"school": "zz", "sports_hall": "qq", "fairground": "ww", "youth_centre": "dd"}

    def put(t):
        for a, b in words.items():
            t = t and t.replace(a, b).replace(a.upper(), b.upper())
        return t

    ods = [(*r[:4], put(r[4]), put(r[5]), *r[6:]) for r in ods]
    osm = [(*r[:6], {k: tags.get(v, put(v)) for k, v in r[6].items()}, put(r[7]), *r[8:]) for r in osm]
    o, p = spark.createDataFrame(ods, ODS), spark.createDataFrame(osm, OSM)
    got = {(r["ods_source_id"], r["osm_source_id"]) for r in m.match(o, p).collect() if r["confidence"] >= m.MATCH}
    assert len(got & truth) >= 0.95 * len(truth)
    assert len(got & truth) >= 0.95 * len(got)


def test_misplaced(spark):
    """Equal name and address in another town: the wrong position loses no candidate."""
    ods, osm, _ = world()
    osm.append(("node/900", "node", 900, 50.2, 6.0, None, dict(osm[1][6]), osm[1][7], osm[1][8], osm[1][9], T, "x"))
    o, p, kinds = m.prepare(spark.createDataFrame(ods, ODS), spark.createDataFrame(osm, OSM))
    ids = m.candidates(o, p, kinds).join(o.select(F.col("h").alias("oh"), F.col("id").alias("o")), "oh").join(p.select(F.col("h").alias("mh"), F.col("id").alias("m")), "mh")
    assert ("o0001", "node/900") in {(r["o"], r["m"]) for r in ids.collect()}


def test_clean_input_of_one_label(spark):
    """Tables whose pairs all agree have labels of one sort: the matches still come out."""
    ods = [("a", "d", "t", (7.0, 51.0), "Grundschule", "Grundschule Amselbach", "Ulmenweg", "3", "x")]
    osm = [("node/1", "node", 1, 51.0, 7.0, None, {"name": "Grundschule Amselbach"}, "Grundschule Amselbach", "Ulmenweg", "3", T, "x")]
    rows = m.match(spark.createDataFrame(ods, ODS), spark.createDataFrame(osm, OSM)).collect()
    assert [(r["ods_source_id"], r["osm_source_id"]) for r in rows if r["confidence"] >= m.MATCH] == [("a", "node/1")]


def test_nulls_and_empty(spark):
    o = spark.createDataFrame([("a", None, None, None, None, None, None, None, None), (None, "d", "t", None, "x", "y", "z", "1", None), ("b", "d", "t", (7.0, 51.0), None, "", "", "", "k"), ("c", "d", "t", (float("nan"), 51.0), "Schule", "n" * 20_000, "s" * 20_000, "9", "k")], ODS)
    p = spark.createDataFrame([("node/1", "node", 1, None, None, None, None, None, None, None, None, None), ("node/2", "node", 2, 51.0, 7.0, None, {"amenity": "school"}, "OSM node 2", None, None, T, "c"), (None, "node", 3, 51.0, 7.0, None, {}, "l", "s", "1", T, "c")], OSM)
    assert m.match(o, p).filter(F.col("confidence") >= m.MATCH).count() == 0
    portal, places, _ = m.prepare(o, p)
    assert portal.count() == 3 and places.count() == 2
    assert m.match(o.limit(0), p.limit(0)).count() == 0


def test_learnt(spark):
    """Common words, those that say a kind, habits of one table, and which kinds go together."""
    ods, osm, _ = world()
    o, p = m.portal_records(spark.createDataFrame(ods, ODS)), m.map_records(spark.createDataFrame(osm, OSM))
    columns = ("name", "cats", "street")
    known = learn(o.select(F.lit(0).alias("side"), *columns).unionByName(p.select(F.lit(1).alias("side"), *columns)))
    assert {"turnhalle", "festplatz"} <= known.kinds(0) and {"grundschule", "turnhalle", "festplatz", "jugendtreff"} <= known.kinds(1)
    assert "am" in known.common[0] and "am" not in known.kinds(0) and "staedt" in known.habits[0]
    assert not {"amselbach", "biberberg"} & known.common[0]


def test_speller():
    spell = Speller({"kindertagesstaette", "grundschule"}, {"am"})
    assert [spell(t) for t in ("kindretagesstaette", "grundschuleam", "grundschule", "gundschule", "erlenrain", "am")] == ["kindertagesstaette", "grundschule am", "grundschule", "grundschule", "erlenrain", "am"]
    assert distance("abcd", "abdc") == 1 and distance("abcd", "bcde") == 2


def test_minhash_agrees_as_the_sets_do():
    texts = pa.array(["amselbachweg", "amselbachweg", "amselbachwek", "quittenhof", "", "a"])
    values = [v.to_pylist() for v in minhash(texts, 5)]
    assert all(v[0] == v[1] and v[4] is None and v[5] is not None for v in values)
    assert sum(v[0] == v[2] for v in values) >= 2 and sum(v[0] == v[3] for v in values) <= 1


def test_parts(spark):
    s = spark.createDataFrame([("Hofdammallee 49", None), ("Kiesbergpl.", "7 a"), ("rebufer-weg", ""), ("Erlenbrucher Strasse 3 b", None), (None, None)], "st string, no string")
    x = m._record(s.select(F.lit("i").alias("id"), F.lit(0).alias("at"), F.lit("").alias("name"), F.array().cast("array<string>").alias("cats"), m.fold(F.col("st")).alias("st"), "no", F.lit(1.0).alias("lat"), F.lit(None).cast("double").alias("lon")))
    assert [(r["street"], r["number"], r["lat"]) for r in x.collect()] == [("hofdammallee", "49", None), ("kiesbergpl", "7a", None), ("rebuferweg", None, None), ("erlenbrucherstrasse", "3b", None), ("", None, None)]


def test_candidates_without_position_and_street(spark):
    """Of one kind and name, one side without position, either or both without street: the name alone makes them candidates."""
    at, no = (7.0, 51.0), None
    base_ods, base_osm, _ = world()  # what kinds there are is learnt from these
    ods = [(f"p{i}", "d", "t", pos, "Grundschule", f"Grundschule Am {stem}", street, None, "x") for i, (stem, pos, street) in enumerate([("Pirolbach", no, "Ulmenweg"), ("Gimpelhang", no, no), ("Uhumoor", at, no), ("Luchstal", at, no), ("Zeisigsee", no, no)])]
    osm = [(f"way/9{i}", "way", i, lat, lon, None, {"amenity": "school", "name": f"Grundschule {stem}"}, stem, street, None, T, "x") for i, (stem, lat, lon, street) in enumerate([("Am Pirolbach", 51.0, 7.0, no), ("Am Gimpelhang", 51.0, 7.0, "Bachplatz"), ("Am Uhumoor", no, no, no), ("Am Luchstal", no, no, "Kirschdamm"), ("Am Zeisigsee", no, no, no)])]
    osm.append(("way/99", "way", 9, None, None, None, {"leisure": "fairground", "name": "Festplatz Am Pirolbach"}, "x", None, None, T, "x"))
    o, p, kinds = m.prepare(spark.createDataFrame(base_ods + ods, ODS), spark.createDataFrame(base_osm + osm, OSM))
    ids = m.candidates(o, p, kinds).join(o.select(F.col("h").alias("oh"), F.col("id").alias("o")), "oh").join(p.select(F.col("h").alias("mh"), F.col("id").alias("m")), "mh").filter("o like 'p%' and m like 'way/9%'")
    got = {(r["o"], r["m"]) for r in ids.collect()}
    assert {(f"p{i}", f"way/9{i}") for i in range(5)} <= got and ("p0", "way/99") not in got


def test_edits_in_bulk():
    """Distances of many pairs at once are those of one by one; long and empty texts too."""
    import random

    from tessera.llm.comparing import Texts

    r = random.Random(3)
    texts = ["", "a", "x" * 70, "x" * 69 + "yz"] + ["".join(r.choice("abcü😀 ") for _ in range(r.randrange(1, 15))) for _ in range(60)]
    t = Texts(pa.array(texts))

    def one(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    import numpy as np

    n = len(t.texts)
    a, b = np.repeat(np.arange(n), n), np.tile(np.arange(n), n)
    assert t.edits(a, b).tolist() == [one(t.texts[i], t.texts[j]) for i, j in zip(a, b)]


def test_versions_in_other_cells(spark):
    """A record whose earlier row lies elsewhere: both rows find candidates, the latest one is compared, each pair comes out once.

    Attributes are kept with the pairs as far as they are alike, not as a row of features with both hashes.
    """
    ods, osm, _ = world()
    row = osm[5]  # of the place it is the first of
    place = next(o for o in ods if o[0] == f"o{row[2]:04d}")
    moved = [(*row[:3], 51.9, 7.9, None, dict(row[6]), row[7], row[8], row[9], datetime(2024, 1, 1), "x"), (*row[:3], row[3], row[4], None, dict(row[6]), "Festplatz Zum Kranichsumpf", row[8], row[9], datetime(2023, 1, 1), "x")]
    moved[1][6]["name"] = "Festplatz Zum Kranichsumpf"
    o, p, kinds = m.prepare(spark.createDataFrame(ods, ODS), spark.createDataFrame(osm + moved, OSM))
    x = m._compared(o, p, kinds)
    assert {"f", "oh", "mh"}.isdisjoint(x.columns)
    got = [r for r in x.filter(F.col("m_id") == row[0]).collect() if r["o_id"] == place[0]]
    assert len(got) == 1 and got[0]["s_name"] > 0.6 and (place[3] is None or got[0]["dist"] < 100)
    assert x.count() == x.select("o_id", "m_id").distinct().count()


def test_work_once_for_equal_texts(monkeypatch):
    """Letter groups are made once for each distinct text, in MinHash values and in what is learnt of streets."""
    from tessera.llm import naming

    made, grams = [], naming.grams
    monkeypatch.setattr(naming, "grams", lambda texts: made.append(len(texts)) or grams(texts))
    texts = pa.array(["amselbachweg", "", "ulmenhang"] * 1000)
    values = minhash(texts, 2)
    b = pa.RecordBatch.from_arrays([pa.array([0, 1, 1] * 1000, pa.int32()), pa.array(["am bach", "", "am"] * 1000), pa.array([["x=y"], [], ["x=y", "z="]] * 1000, pa.list_(pa.string())), texts], names=["side", "name", "cats", "street"])
    n = {(w, s, k): v for r in naming._counted(iter([b, b])) for w, s, k, v in zip(*(r.column(c).to_pylist() for c in ("what", "side", "key", "n")))}
    assert max(made) == 3
    assert values[0].to_pylist() == minhash(texts[:3], 2)[0].to_pylist() * 1000
    assert {k: v for k, v in n.items() if k[0] != "gram"} == {("records", 0, ""): 2000, ("records", 1, ""): 4000, ("word", 0, "am"): 2000, ("word", 0, "bach"): 2000, ("word", 1, "am"): 2000, ("category", 0, "x=y"): 2000, ("category", 1, "x=y"): 2000, ("category", 1, "z="): 2000, ("streets", 0, ""): 4000}
    assert {v for k, v in n.items() if k[0] == "gram"} == {2000}


def test_counts_beyond_the_bound(monkeypatch):
    """Counts that are sent on in between add up to the same."""
    from collections import Counter

    from tessera.llm import naming

    monkeypatch.setattr(naming, "FLUSH", 50)
    batches = [pa.RecordBatch.from_arrays([pa.array([i % 2] * 40, pa.int32()), pa.array([f"w{i * j % 97} am" for j in range(40)]), pa.array([[]] * 40, pa.list_(pa.string())), pa.array([""] * 40)], names=["side", "name", "cats", "street"]) for i in range(20)]
    got = Counter()
    for r in naming._counted(iter(batches)):
        for w, s, k, n in zip(*(r.column(c).to_pylist() for c in ("what", "side", "key", "n"))):
            got[w, s, k] += n
    want = Counter(("word", i % 2, w) for i in range(20) for j in range(40) for w in (f"w{i * j % 97}", "am"))
    assert {k: n for k, n in got.items() if k[0] == "word"} == want and got["records", 0, ""] == 400


def test_records_without_versions_are_not_read_again(spark):
    """Where no record has several versions, there's nothing to sort or to join."""
    ods, osm, _ = world(64)
    _, p, _ = m.prepare(spark.createDataFrame(ods, ODS), spark.createDataFrame(osm, OSM))
    x = m._versions(p.withColumns({"v": F.xxhash64(*m.VERSION), "cell": F.lit(1).cast("long")}), "v", "cell")
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert x.columns == ["v", "last", "cell"] and x.count() == 0 and "LocalRelation" in plan and "parquet" not in plan


def test_least_confidence(spark):
    ods, osm, _ = world(64)
    o, p = spark.createDataFrame(ods, ODS), spark.createDataFrame(osm, OSM)
    rows = {tuple(r) for r in m.match(o, p).collect()}
    assert {tuple(r) for r in m.match(o, p, least=m.MATCH).collect()} == {r for r in rows if r[2] >= m.MATCH}


def test_fold_of_plain_and_other_letters(spark):
    x = spark.createDataFrame([("ÄÖÜß-Straße 3",), (" St. Mary's  (Alt) ",), ("Île №5",), ("",), (None,), ("Ⅷ. ²Ω",), ("A\tB\n1",)], "c string")
    assert [r[0] for r in x.select(m.fold(F.col("c"))).collect()] == ["aeoeuess strasse 3", "st mary s alt", "île 5", "", "", "ⅷ ²ω", "a b 1"]
