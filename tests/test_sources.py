from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from tessera.schema import node_id
from tessera.sources import council, feeds, places
from tessera.sources.common import read_landed
from tessera.storage import scratch

T0 = datetime(2024, 1, 1)


def now():
    return F.lit(T0)


def emitted(df):
    rows = df.collect()
    for r in rows:
        assert r["id"] and r["source"] and r["observed_at"] == T0 and r["inferred"] is False and len(r["label"]) <= 200
    return [(r, json.loads(r["properties"])) for r in rows]


def test_geo_spine(spark):
    ddl = "dataset string, record struct<stadtbezirk_nr:string,stadtbezirk_bezeichnung:string,statistischer_bezirk_nr:string,statistischer_bezirk:string,geografische_polygone:struct<type:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
    g = ("Feature", ("Polygon", [[[7.0, 51.0], [7.1, 51.0], [7.1, 51.1]]]))
    raw = spark.createDataFrame([("stadtbezirke", ("1", "Nord", None, None, g)), ("stat_bezirke", ("1", None, "11", "Hafen", g)), ("stat_bezirke", ("9", None, "91", None, None)), ("other", (None, None, None, None, None))], ddl)
    df = places.geo_spine(raw, now())
    rows = emitted(df)
    assert [(r["source_id"], r["label"]) for r, _ in rows] == [("1", "Nord"), ("11", "Hafen"), ("91", "Unknown")]
    assert rows[1][1]["_parent_source_id"] == "1" and rows[0][1]["_parent_source_id"] is None and rows[0][0]["rings"]
    e = places.area_hierarchy(df, now()).collect()
    assert [(x["edge_type"], x["from_node_id"], x["to_node_id"]) for x in e] == [("PART_OF", rows[1][0]["id"], rows[0][0]["id"])]


def test_overpass(spark):
    ddl = "type string, id bigint, lat double, lon double, center struct<lat:double,lon:double>, tags map<string,string>"
    raw = spark.createDataFrame([("way", 5, None, None, (51.0, 7.0), {"brand": "B", "contact:phone": "1"}), ("node", 6, 51.5, 7.5, None, {"name": "", "shop": "x"}), ("node", 7, None, None, None, None)], ddl)
    (a, pa), (b, pb), (c, _) = emitted(places.overpass(raw, now()))
    assert (a["source_id"], a["label"], a["lat"], pa["phone"]) == ("way/5", "B", 51.0, "1")
    assert (b["label"], b["lon"], pb["shop"]) == ("OSM node 6", 7.5, "x") and c["label"] == "OSM node 7"


def test_small_places(spark):
    p = "_dataset string, _poi_type string, geo_point_2d struct<lon:double,lat:double>, objektart string, objektname string, strasse string, hausnummer string, stadtbezbe string, statbezibe string, i_zusinfo string, link string"
    (r, props), (q, _) = emitted(places.ods_pois(spark.createDataFrame([("wochenmarkt", "market", (7.5, 51.5), "Markt", "Am See", "S", "1", "Nord", "Hafen", "Markttag: freitags", None), (None,) * 11], p), now()))
    assert len(r["source_id"]) == 20 and props["info"] == "Markttag: freitags" and q["label"] == "Unbenannt" and q["lat"] is None
    s = "_dataset string, _year int, stadtbezirk string, stadtbezirk_nr string, durchschnittsalter double, minderjahrigenanteil double, altenanteil double, hochbetagtenanteil double"
    ((r, props),) = emitted(places.ods_stats(spark.createDataFrame([("d", 2023, "Nord", "1", 44.5, 1.0, 2.0, 3.0)], s), now()))
    assert r["valid_from"] == datetime(2023, 1, 1) and r["label"] == "Nord Demografie 2023" and props["durchschnittsalter"] == 44.5
    (a, _), (b, pb) = emitted(places.strassen(spark.createDataFrame([("Weg", "00123", "k"), ("Gasse", None, "k")], "strassenname string, strassenschlussel string, kommune string"), now()))
    assert a["source_id"] == "00123" and b["source_id"] == "Gasse" and pb["stat_bezirk"] is None and a["lat"] is None
    seg = "strassenname string, strassenschlussel string, strassenabschnittsnummer string, lange_strassenabschnitt_m string, strassenklasse string, strassengruppe string, geo_shape struct<type:string,geometry:struct<type:string,coordinates:array<array<double>>>>"
    (a, pa), (b, pb) = emitted(places.strassenabschnitte(spark.createDataFrame([("Weg", "1", "2", "12.7", "K", "G", ("Feature", ("LineString", [[7.0, 51.0], [7.1, 51.1]]))), (None, None, None, "x", None, None, None)], seg), now()))
    assert a["source_id"] == "1-2" and pa["length_m"] == 12 and a["rings"] == [[[7.0, 51.0], [7.1, 51.1]]] and pb["length_m"] is None and pb["road_type"] == "segment"
    bau = "geografische_koordinate struct<lon:double,lat:double>, art_der_baumassnahme string, auftraggeber string, einschrankung string, zeitraum string, von string, bis string, stadtbezirk string, status string, kommune string"
    ((r, props),) = emitted(places.baustellen(spark.createDataFrame([((7.5, 51.5), "Kanal", "Stadt", None, "", "2024-02-01", "2024-03-01", "Nord", "", "")], bau), now()))
    assert (r["valid_from"], r["valid_to"]) == (datetime(2024, 2, 1), datetime(2024, 3, 1)) and props["planned_end"] == "2024-03-01"


def test_council(spark):
    s = "datum string, beginn string, gremium string, sitzungsort string, kommune string"
    (a, pa), (b, _), (c, _) = emitted(council.gremientermine(spark.createDataFrame([("2024-03-05", "16:00:00", "Rat", "Saal", "k"), ("2024-03-05", "17:00:00", "Rat", "Saal", "k"), (None,) * 5], s), now()))
    assert a["label"] == "Rat 2024-03-05" and a["valid_from"] == datetime(2024, 3, 5, 16) and a["source_id"] != b["source_id"] and c["label"] == "Unbekanntes Gremium "
    html = "1 Eins<br>Drucksache Nr. 11111-24 einstimmig.<br>1 Eins neu<br>2 Zwei<br>Drucksache Nr. 22222-24 abgelehnt. Drucksache Nr. 33333-24 genehmigt."
    m = council.minutes(spark.createDataFrame([("https://x/?documentId=D1", "Rat", "2024-03-05", html), ("https://x/", "Rat", "2024-03-05", html)], "link string, gremium string, datum string, html string"))
    nodes, edges = council.niederschriften(m, now())
    by = {}
    for r, p in emitted(nodes):
        by.setdefault(r["node_type"], {})[r["source_id"]] = p
    assert set(by["Meeting"]) == {"D1"} and set(by["AgendaItem"]) == {"D1#1", "D1#2"} and by["AgendaItem"]["D1#1"]["title"] == "Eins neu"
    assert by["AgendaItem"]["D1#2"]["result"] is None and {k: p["passed"] for k, p in by["Resolution"].items()} == {"11111-24": True, "22222-24": False, "33333-24": True}
    assert sorted(json.loads(e["properties"])["relation"] for e in edges.collect()) == ["agenda_of"] * 2 + ["decided_in"] * 3
    assert edges.join(nodes.select(F.col("id").alias("from_node_id")), "from_node_id", "left_anti").count() == 0


def test_oparl(spark):
    ddl = "oparl_type string, data struct<id:string,name:string,modified:string,deleted:boolean,organizationType:string,title:string,membership:array<struct<organization:struct<classification:string,shortName:string,name:string>>>,start:string,end:string,organization:array<string>,agendaItem:array<struct<id:string,number:string,name:string,public:boolean,resolution:array<struct<id:string,name:string,resolutionNumber:string>>>>>"
    raw = spark.createDataFrame([
        ("Organization", ("o1", "Rat", None, None, "committee", None, None, None, None, None, None)), ("Person", ("p1", "Ada", None, False, None, "Mitglied", [(("committee", None, "x"),), (("party", "ABC", "Partei"),)], None, None, None, None)),
        ("Meeting", ("m1", "Sitzung", None, None, None, None, None, "2024-05-01T16:00:00+02:00", None, ["o1"], [("a1", "1", "Punkt", None, [("r1", "Beschluss", "7")])])), ("Person", ("p2", "Weg", None, True, None, None, None, None, None, None, None)),
    ], ddl)
    nodes, edges = council.oparl(raw, now())
    assert sorted(r["node_type"] for r, _ in emitted(nodes)) == ["AgendaItem", "Meeting", "Organization", "Person", "Resolution"]
    assert [p["party"] for r, p in emitted(nodes) if r["node_type"] == "Person"] == ["ABC"]
    assert [r["edge_type"] for r in edges.collect()] == ["PASSED_BY"]


def test_elections(spark):
    shares = spark.createDataFrame([("d", "result", "kommunalwahl", "2020-09-13", 900, 500, 55.5, None, None, "now", "k")], "_dataset string, _kind string, _type string, tag_der_wahl string, gultige_stimmen bigint, spd_absolut bigint, spd_in double, cdu_absolut bigint, cdu_in double, erzeugt_am string, kommune string")
    ((r, p),) = emitted(council.wahlergebnisse(shares, now()))
    assert p["party_shares"] == {"spd": {"votes": 500, "pct": 55.5}} and p["party_seats"] is None and r["valid_from"] == datetime(2020, 9, 13)
    seats = spark.createDataFrame([("d", "seats", "council_composition", "2020-09-13", 90, 30, 0, None, "now", "k")], "_dataset string, _kind string, _type string, tag_der_wahl string, sitze_insgesamt int, spd int, x int, cdu int, erzeugt_am string, kommune string")
    ((r, p),) = emitted(council.wahlergebnisse(seats, now()))
    assert p["party_seats"] == {"spd": 30} and p["seats_total"] == 90
    ddl = "_dataset string, _wahltermin string, wahltermin string, stadtbezirk_nr int, stadtbezirk string, kommunalwahlbezirk_nr string, kommunalwahlbezirk string, stimmbezirk string, wahlberechtigte int, wahler_innen int, gultige_stimmen int, ungultige_stimmen int, spd int, cdu int, geo_point_2d struct<lon:double,lat:double>, ostwert string, kommune string"
    (a, pa), (b, pb) = emitted(council.stimmbezirke(spark.createDataFrame([("d", "2014-05-25", "", 1, "Nord", None, None, "101", 1000, 226, 220, 6, 100, 0, (7.5, 51.5), None, "k"), ("d", "2014-05-25", "2014-05-25", 1, None, None, None, "102", 0, 5, None, None, None, 3, None, None, "k")], ddl), now()))
    assert pa["turnout_pct"] == 22.6 and pa["party_votes"] == {"spd": 100} and a["lat"] == 51.5 and pb["turnout_pct"] is None and pb["party_votes"] == {"cdu": 3} and b["lat"] is None


def test_feeds(spark):
    w = "timestamp string, temperature double, precipitation double, wind_speed double, condition string, _source struct<id:int,dwd_station_id:string,station_name:string,lat:double,lon:double>"
    (a, pa), (b, _) = emitted(feeds.brightsky(spark.createDataFrame([("2024-01-01T10:00:00+00:00", 1.5, None, None, "dry", (1, "90", "Warte", 51.1, 7.1)), (None, None, None, None, None, None)], w), now()))
    assert a["source_id"] == "90|2024-01-01T10:00:00+00:00" and a["valid_from"] == datetime(2024, 1, 1, 10) and pa["temperature"] == 1.5 and b["lat"] == feeds.HOME_LAT
    rss = "guid string, title string, link string, description string, pubDate string"
    (a, pa), (b, pb) = emitted(feeds.polizei_rss(spark.createDataFrame([("g", "Kundgebung", "http://x", "<b>Ruhig</b>", "Mon, 08 Dec 2025 00:00:00 +0100"), (None, "", "http://y", None, "")], rss), now()))
    assert pa["event_type"] == "demonstration" and pa["description"] == "Ruhig" and a["valid_from"] == datetime(2025, 12, 7, 23) and b["label"] == "Polizeimeldung" and b["valid_from"] is None and pb["event_type"] == "police_report"
    ev = "id string, type string, website_url string, contentTags array<struct<value:string,parentValues:array<string>>>, content array<struct<data:struct<startDateTime:string,startCalendarDay:struct<date:string>,isCancelled:boolean,isSoldOut:boolean,freeOfCharge:boolean,event:struct<title:string,description:string,text:string>>>>"
    d = (("2027-06-12T10:00:00.000000+0200", None, None, None, True, ("Fest", "", "<p>Text</p>")),)
    ((a, p),) = emitted(feeds.city_events(spark.createDataFrame([("1", "eventdatetime", "/e", [("Musik", ["Veranstaltungskalender"]), ("Nord", ["Stadtbezirke"])], [d]), ("2", "page", "/p", [], [d]), ("3", "eventdatetime", "", None, [])], ev), now()))
    assert (a["valid_from"], p["category"], p["stadtbezirk"], p["description"], p["free_of_charge"], p["is_cancelled"]) == (datetime(2027, 6, 12, 8), "Musik", "Nord", "Text", True, False)
    xml = "<n>Dortmund<cbc:ContractFolderID x='1'>F1</cbc:ContractFolderID><cac:ProcurementProject>\n<cbc:Name>Bau</cbc:Name></cac:ProcurementProject><cbc:SubTypeCode>16</cbc:SubTypeCode><cbc:IssueDate>2026-06-28+02:00</cbc:IssueDate></n>"
    ((a, p),) = emitted(feeds.vergabe(spark.createDataFrame([(xml,), (xml.replace("Dortmund", "Bochum"),), (None,), ("Dortmund",)], "xml string"), now()))
    assert (a["label"], p["tender_type"], a["valid_from"]) == ("Bau", "works", datetime(2026, 6, 27, 22))


def test_transit(spark):
    stops = feeds.gtfs_stops(spark.createDataFrame([("s1", "Halt", "", "", "", "51.5", "7.5"), ("s2", "Fern", "", "", "", "50", "7.5"), ("s3", "", "", "", "", "x", "7.5")], "stop_id string, stop_name string, stop_code string, platform_code string, wheelchair_boarding string, stop_lat string, stop_lon string"))
    assert [r["stop_id"] for r in stops.collect()] == ["s1"]
    routes = spark.createDataFrame([("r1", "1", "Lang", "3", "a"), ("r2", "2", "", "3", "a")], "route_id string, route_short_name string, route_long_name string, route_type string, agency_id string")
    served = feeds.gtfs_routes(stops, spark.createDataFrame([("s1", "t1"), ("s2", "t2")], "stop_id string, trip_id string"), spark.createDataFrame([("t1", "r1"), ("t2", "r2")], "trip_id string, route_id string"), routes)
    assert [r["label"] for r, _ in emitted(feeds.gtfs_static(stops, served, now()))] == ["Halt", "Lang"]
    rt = spark.createDataFrame([("alert", "a", "L" * 300, "d", T0, ["r1"], None), ("delay", "b", "late", None, T0, None, 599), ("delay", "c", "later", None, None, None, 600)], "kind string, source_id string, label string, description string, valid_from timestamp, route_ids array<string>, delay_s int")
    assert [r["source_id"] for r, _ in emitted(feeds.gtfs_realtime(rt, now()))] == ["a", "c"]
    u = spark.createDataFrame([([(None, 30), (700, None)],), ([],), (None,)], "u array<struct<arrival_delay:int,departure_delay:int>>")
    assert [r[0] for r in u.select(feeds.greatest_delay(F.col("u"))).collect()] == [700, 0, 0]


def test_air_and_motorway(spark):
    path = scratch(spark, "air")
    lines = spark.createDataFrame([("Datum;Zeit;VDOM NO2 1H;VDOM PM10F 24H;DOMA O3 1H;DOMA Wind;XYZ NO2",), ("31.12.2024;23:00;10,5;<7;20;1;4",), ("31.12.2024;24:00;26,3;--;30;1;4",)], "value string").coalesce(1)
    lines.write.text(path)
    wide = read_landed(spark, path, "csv", None, sep=";", header="true", encoding="ISO-8859-1")
    rows = {r["source_id"].split("|")[0]: (r, p) for r, p in emitted(feeds.lanuv_air(wide, now()))}
    assert set(rows) == {"VDOM", "DOMA"} and rows["VDOM"][0]["source_id"] == "VDOM|31.12.2024|24:00" and rows["VDOM"][0]["valid_from"] == datetime(2025, 1, 1)
    assert (rows["VDOM"][1]["no2"], rows["VDOM"][1]["pm10"], rows["DOMA"][1]["o3"], rows["DOMA"][1]["no2"]) == (26.3, None, 30.0, None)
    assert (rows["VDOM"][0]["lat"], rows["VDOM"][0]["lon"]) == (51.52355, 7.48356)
    assert feeds.lanuv_air(wide.select("Datum", "Zeit", "XYZ NO2"), now()).count() == 0
    ddl = "_road string, _kind string, _lat double, _lon double, identifier string, title {0}, subtitle string, description {0}, isBlocked boolean, startTimestamp string, coordinate struct<lat:double,long:double>"
    a = spark.createDataFrame([("A1", "roadwork", 51.5, 7.5, "i1", ["A1", "AS"], "nach", ["x"], None, "2024-01-01T00:00:00+01:00", None), ("A1", "closure", 40.0, 7.5, "i2", None, "", [], True, "bald", None)], ddl.format("array<string>"))
    (r, p), (q, pq) = emitted(feeds.autobahn(a, now()))
    assert (r["node_type"], r["label"], p["reason"], p["is_blocked"]) == ("ConstructionSite", "A1 AS", "nach", False) and (q["node_type"], q["label"], pq["event_type"], q["valid_from"]) == ("Event", "A1 closure", "road_closure", None)
    assert feeds.autobahn(a, now(), feeds.BOX).count() == 1
    assert emitted(feeds.autobahn(spark.createDataFrame([("A1", "warning", 51.5, 7.5, "i3", "Text", None, None, None, None, None)], ddl.format("string")), now()))[0][1]["event_type"] == "traffic_disruption"


def test_rss_and_ids(spark):
    path = scratch(spark, "rss")
    xml = "<rss><channel><item><guid>g1</guid><title>Unfall</title><link>http://x</link><description>d</description><pubDate>Mon, 08 Dec 2025 00:00:00 +0100</pubDate></item></channel></rss>"
    spark.createDataFrame([(xml,)], "value string").coalesce(1).write.text(path)
    raw = read_landed(spark, path, "xml", "guid string, title string, link string, description string, pubDate string", rowTag="item")
    assert emitted(feeds.polizei_rss(raw, now()))[0][1]["event_type"] == "traffic_accident"
    ids = spark.range(1).select(node_id(F.lit("a"), F.lit("b")).alias("x"), node_id(F.lit("a"), F.lit("b")).alias("y"), node_id(F.lit("a"), F.lit("c")).alias("z")).first()
    assert ids["x"] == ids["y"] != ids["z"]
