from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from tessera.sources import feeds, landed


def put(folder, name, data):
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return f"file://{folder}"


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "."), text)
    return out.getvalue()


def now():
    return F.lit("2026-01-01T00:00:00Z").cast("timestamp")


def test_json_pages(spark, tmp_path):
    put(tmp_path, "1.json", json.dumps({"data": [{"id": "a", "n": 1}, {"id": "b"}], "next": 2}))
    path = put(tmp_path, "2.json", json.dumps({"error": "x"}))
    assert sorted(map(tuple, landed.json_pages(spark, path, "id string, n int").collect())) == [("a", 1), ("b", None)]


def test_rss(spark, tmp_path):
    path = put(tmp_path, "feed.xml", "<rss><channel><title>t</title><item><guid>g</guid><title>Unfall</title><pubDate>Mon, 08 Dec 2025 00:00:00 +0100</pubDate></item><item><guid>h</guid></item></channel></rss>")
    assert [(r["guid"], r["title"]) for r in landed.rss(spark, path).orderBy("guid").collect()] == [("g", "Unfall"), ("h", None)]


def test_tenders_in_archives(spark, tmp_path):
    xml = "<n><cbc:ContractFolderID>1</cbc:ContractFolderID><cac:ProcurementProject><cbc:Name>Brücke</cbc:Name></cac:ProcurementProject><cbc:SubTypeCode>16</cbc:SubTypeCode>Dortmund</n>"
    put(tmp_path, "a.zip", archive(a__xml=xml, b__txt="no", c__XML=xml.replace("Dortmund", "Hamm").replace(">1<", ">2<")))
    path = put(tmp_path, "broken.zip", b"PK no archive")
    t = landed.zip_texts(spark, path)
    assert sorted(r["file"] for r in t.collect()) == ["a.xml", "c.XML"]
    assert [r["label"] for r in feeds.vergabe(t, now()).collect()] == ["Brücke"]
    put(tmp_path, "text.zip", "plain")
    assert [r["path"].rsplit("/", 1)[1] for r in landed.unreadable(spark, path).collect()] == ["text.zip"]


def test_timetable(spark, tmp_path):
    path = put(tmp_path, "gtfs.zip", archive(stops__txt='﻿stop_id,stop_name,stop_lat,stop_lon\ns1,"Markt, Nord",51.5,7.5\ns2,Fern,50,7.5\n', other_stops__txt="stop_id\nx\n"))
    stops = landed.zip_csv(spark, path, "stops.txt", ("stop_id", "stop_name", "stop_code", "platform_code", "wheelchair_boarding", "stop_lat", "stop_lon"))
    assert sorted(r["stop_id"] for r in stops.collect()) == ["s1", "s2"]
    assert [(r["stop_id"], r["stop_name"]) for r in feeds.gtfs_stops(stops).collect()] == [("s1", "Markt, Nord")]


def test_air_table(spark, tmp_path):
    text = 'Kommentar; mit Semikolon\n"Datum";"Zeit";"VDOM NO2 1H Mittelwert [µg/m³]";"VDOM O3 1H"\n"31.12.2024";"23:00";"10,5";"1"\n"31.12.2024";"24:00";"<7";"26,3"\n\n'
    path = put(tmp_path, "air.csv", text.encode("latin-1"))
    wide = landed.commented_csv(spark, path)
    assert wide.columns[2] == "VDOM NO2 1H Mittelwert [µg/m³]" and wide.count() == 2
    r = feeds.lanuv_air(wide, now()).first()
    p = json.loads(r["properties"])
    assert (r["source_id"], p["no2"], p["o3"]) == ("VDOM|31.12.2024|24:00", None, 26.3)
    empty = tmp_path / "none"
    empty.mkdir()
    assert landed.commented_csv(spark, put(empty, "x.csv", "nothing")).count() == 0
