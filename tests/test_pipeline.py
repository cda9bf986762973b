from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.functions import geo, text
from tessera.functions.sql import register_functions
from tessera.plans import pipeline
from tessera.plans import world as w
from tessera.storage import scratch

NOW = datetime(2026, 1, 1)


def test_load_twice_then_derive(spark, data):
    t = pipeline.Tables(spark, scratch(spark, "graph"))
    steps = [("areas", lambda _: (w.areas(spark, data), None)), ("places", lambda _: (w.osm(spark, data).unionByName(w.pois(spark, data)), None)), ("broken", lambda _: 1 / 0), ("located", pipeline.locate("POI")), ("texts", lambda _: (w.texts(spark, data), None)), ("linked", pipeline.link_texts(("Event", "Resolution", "POI")))]
    assert pipeline.full_load(t, steps, NOW) == {"areas": True, "places": True, "broken": False, "located": True, "texts": True, "linked": True}
    nodes, edges = t.read("nodes").count(), t.read("edges").count()
    assert edges > 0
    # A second load touches what is there and inserts nothing.
    pipeline.full_load(t, steps, NOW + timedelta(days=1))
    assert (t.read("nodes").count(), t.read("edges").count()) == (nodes, edges)
    log = t.read("ingestion_runs")
    assert {(r["connector"], r["status"]) for r in log.collect()} == {("broken", "error"), *((n, "ok") for n in ("areas", "places", "located", "texts", "linked"))}
    pipeline.resolve_entities(t, NOW)
    first = t.read("resolution_candidates").count()
    pipeline.resolve_entities(t, NOW)
    assert t.read("resolution_candidates").count() == first

    def answer(asked):
        return asked.withColumn("raw", F.lit(json.dumps({"insights": [{"description": "Twice the work. More.", "confidence": 0.8}, {"confidence": 0.2}]})))

    n = pipeline.scan(t, answer, NOW)
    assert n > 0 and n == t.read("insights").count() and pipeline.scan(t, answer, NOW) == 0
    assert t.read("insights").first()["title"] == "Twice the work"


def test_sql_functions(spark):
    register_functions(spark)
    df = spark.createDataFrame([("Große  Straße", "grosse strasse", 51.0, 7.0), (None, "", None, 7.0)], "a string, b string, lat double, lon double")
    df.createOrReplaceTempView("t")
    ring = [[6.9, 50.9], [7.1, 50.9], [7.1, 51.1]]
    r = spark.sql(f"SELECT normalize_text(a) n, trigram_similarity(a, b) s, distance_m(lat, lon, 51.1, 7.0) d, within_rings(lat, lon, array({'array(' + ', '.join(f'array({x}D, {y}D)' for x, y in ring) + ')'})) w, valid_at(NULL, NULL, NULL) v FROM t").collect()
    rings = F.array(F.array(*[F.array(*map(F.lit, p)) for p in ring]))
    want = df.select(text.normalize(F.col("a")), text.similarity(F.col("a"), F.col("b")), geo.haversine(F.col("lat"), F.col("lon"), F.lit(51.1), F.lit(7.0)), geo.within(F.col("lat"), F.col("lon"), rings), F.lit(True)).collect()
    assert [tuple(x) for x in r] == [tuple(x) for x in want]
