"""Queries on the sources whose feeds aren't among the test tables: their raw records are written from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import council, feeds, places
from tessera.storage import load

QUERIES: dict = {}
SQL: dict = {}
C = F.col


def now() -> Column:
    return F.lit("2026-01-01T00:00:00Z").cast("timestamp")


def prop(k: str) -> Column:
    return F.get_json_object("properties", f"$.{k}")


def query(name: str, sql: str):
    def put(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return put


@query("police_nodes", """SELECT substr(sha256('g' || doc_id), 1, 20) AS source_id, CASE WHEN regexp_matches(t, 'versammlung|demonstration|kundgebung|aufzug') THEN 'demonstration' WHEN regexp_matches(t, 'unfall|verkehr|kollision') THEN 'traffic_accident' WHEN regexp_matches(t, 'razzia|durchsuchung|festnahme') THEN 'police_operation' ELSE 'police_report' END AS kind, from_s
FROM (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g')) AS t, epoch_us(published_at) // 1000000 AS from_s FROM documents WHERE source = 'polizei_rss')""")
def police_nodes(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "documents").filter("source = 'polizei_rss'")
    raw = x.select(F.concat(F.lit("g"), C("doc_id").cast("string")).alias("guid"), F.lit("Meldung").alias("title"), F.lit("https://example.org/p").alias("link"), C("text").alias("description"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss Z").alias("pubDate"))
    return feeds.polizei_rss(raw, now()).select("source_id", prop("event_type").alias("kind"), F.unix_seconds("valid_from").alias("from_s"))


@query("city_event_nodes", "SELECT doc_id::VARCHAR AS source_id, 'Fest ' || doc_id AS label, coalesce(lang, 'null') AS category, epoch_us(published_at) // 1000000 AS from_s, doc_id % 2 = 0 AS free FROM documents WHERE source = 'dortmund_events'")
def city_event_nodes(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "documents")
    tags = F.array(F.struct(F.lit("Nord").alias("value"), F.array(F.lit("Stadtbezirke")).alias("parentValues")), F.struct(F.coalesce("lang", F.lit("null")).alias("value"), F.array(F.lit("Veranstaltungskalender")).alias("parentValues")))
    event = F.struct(F.concat(F.lit("Fest "), C("doc_id").cast("string")).alias("title"), C("text").alias("description"), F.lit(None).cast("string").alias("text"))
    data = F.struct(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSZ").alias("startDateTime"), F.struct(F.lit(None).cast("string").alias("date")).alias("startCalendarDay"), F.lit(False).alias("isCancelled"), F.lit(None).cast("boolean").alias("isSoldOut"), (C("doc_id") % 2 == 0).alias("freeOfCharge"), event.alias("event"))
    kind = F.when(C("source") == "dortmund_events", "eventdatetime").otherwise("page")
    raw = x.select(C("doc_id").cast("string").alias("id"), kind.alias("type"), F.lit("/v").alias("website_url"), tags.alias("contentTags"), F.array(F.struct(data.alias("data"))).alias("content"))
    n = feeds.city_events(raw, now())
    return n.select("source_id", "label", prop("category").alias("category"), F.unix_seconds("valid_from").alias("from_s"), prop("free_of_charge").cast("boolean").alias("free"))


@query("construction_nodes", """SELECT substr(sha256(o_orderpriority || '|' || von || '|' || (7 + o_custkey % 10)::VARCHAR || '.5|' || (51)::VARCHAR || '.25'), 1, 20) AS source_id, o_orderpriority AS label, epoch_us(o_orderdate::DATE::TIMESTAMP) // 1000000 AS from_s, epoch_us(o_orderdate::DATE::TIMESTAMP) // 1000000 + 2592000 AS to_s
FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS von FROM orders)""")
def construction_nodes(s: SparkSession, d: str) -> DataFrame:
    o = load(s, d, "orders")
    spot = F.struct((C("o_custkey") % 10 + 7.5).alias("lon"), F.lit(51.25).alias("lat"))
    raw = o.select(spot.alias("geografische_koordinate"), C("o_orderpriority").alias("art_der_baumassnahme"), F.lit("Stadt").alias("auftraggeber"), F.lit(None).cast("string").alias("einschrankung"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("von"), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd").alias("bis"), F.lit("Nord").alias("stadtbezirk"))
    return places.baustellen(raw, now()).select("source_id", "label", F.unix_seconds("valid_from").alias("from_s"), F.unix_seconds("valid_to").alias("to_s"))


@query("demographics_nodes", "SELECT substr(sha256('demo|' || n_nationkey), 1, 20) AS source_id, n_name || ' Demografie ' || (2020 + n_nationkey % 5) AS label, epoch_us(make_date(2020 + n_nationkey % 5, 1, 1)::TIMESTAMP) // 1000000 AS from_s FROM nation")
def demographics_nodes(s: SparkSession, d: str) -> DataFrame:
    values = [F.lit(1.0).alias(v) for v in ("durchschnittsalter", "minderjahrigenanteil", "altenanteil", "hochbetagtenanteil")]
    raw = load(s, d, "nation").select(F.lit("demo").alias("_dataset"), (C("n_nationkey") % 5 + 2020).cast("int").alias("_year"), C("n_name").alias("stadtbezirk"), C("n_nationkey").cast("string").alias("stadtbezirk_nr"), *values)
    return places.ods_stats(raw, now()).select("source_id", "label", F.unix_seconds("valid_from").alias("from_s"))


@query("street_nodes", "SELECT CASE WHEN p_partkey % 10 = 0 THEN p_name ELSE p_partkey::VARCHAR END AS source_id, p_name AS label FROM part")
def street_nodes(s: SparkSession, d: str) -> DataFrame:
    raw = load(s, d, "part").select(C("p_name").alias("strassenname"), F.when(C("p_partkey") % 10 != 0, C("p_partkey").cast("string")).alias("strassenschlussel"), F.lit("k").alias("kommune"))
    return places.strassen(raw, now()).select("source_id", "label")


@query("segment_nodes", "SELECT l_orderkey || '-' || l_linenumber AS source_id, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity::INT END AS length_m, 7.0 + l_linenumber / 8.0::DOUBLE AS lon FROM lineitem")
def segment_nodes(s: SparkSession, d: str) -> DataFrame:
    x = 7.0 + C("l_linenumber") / 8.0
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.array(x, F.lit(51.0)), F.array(x, F.lit(51.1))).alias("coordinates"))
    raw = load(s, d, "lineitem").select(F.lit("Weg").alias("strassenname"), C("l_orderkey").cast("string").alias("strassenschlussel"), C("l_linenumber").cast("string").alias("strassenabschnittsnummer"), F.when(C("l_linenumber") % 3 == 0, "n/a").otherwise(C("l_quantity").cast("string")).alias("lange_strassenabschnitt_m"), F.lit("K").alias("strassenklasse"), F.lit("G").alias("strassengruppe"), F.struct(F.lit("Feature").alias("type"), line.alias("geometry")).alias("geo_shape"))
    return places.strassenabschnitte(raw, now()).select("source_id", prop("length_m").cast("int").alias("length_m"), "lon")


@query("election_nodes", """SELECT substr(sha256('wahl|' || day), 1, 20) AS source_id, 'kommunalwahl ' || day AS label, votes, pct FROM (SELECT n_name || n_nationkey AS day, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey * 10 END AS votes, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey / 2.0 END::DOUBLE AS pct FROM nation)""")
def election_nodes(s: SparkSession, d: str) -> DataFrame:
    k = C("n_nationkey")
    raw = load(s, d, "nation").select(F.lit("wahl").alias("_dataset"), F.lit("result").alias("_kind"), F.lit("kommunalwahl").alias("_type"), F.concat("n_name", k.cast("string")).alias("tag_der_wahl"), F.lit(900).cast("long").alias("gultige_stimmen"), F.when(k % 4 != 0, k.cast("long") * 10).alias("abc_absolut"), (k / 2.0).alias("abc_in"))
    return council.wahlergebnisse(raw, now()).select("source_id", "label", prop("party_shares.abc.votes").cast("int").alias("votes"), prop("party_shares.abc.pct").cast("double").alias("pct"))


@query("precinct_nodes", """SELECT substr(sha256('rat|' || c_custkey), 1, 20) AS source_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE round(100.0 * (c_custkey % 7) / 8, 2) END::DOUBLE AS turnout, nullif(c_custkey % 3, 0)::INT AS abc FROM customer""")
def precinct_nodes(s: SparkSession, d: str) -> DataFrame:
    k = C("c_custkey")
    null = F.lit(None).cast("string")
    raw = load(s, d, "customer").select(F.lit("rat").alias("_dataset"), F.lit("2020-09-13").alias("_wahltermin"), null.alias("wahltermin"), F.lit("Nord").alias("stadtbezirk"), k.cast("string").alias("stimmbezirk"), F.lit(8).alias("wahlberechtigte"), (k % 7).cast("int").alias("wahler_innen"), (k % 3).cast("int").alias("abc"), F.struct(F.lit(7.5).alias("lon"), F.lit(51.5).alias("lat")).alias("geo_point_2d"))
    return council.stimmbezirke(raw, now()).select("source_id", prop("turnout_pct").cast("double").alias("turnout"), prop("party_votes.abc").cast("int").alias("abc"))


@query("transit_nodes", """SELECT 'stop/' || s_suppkey AS source_id, 'TransitStop' AS node_type, s_name AS label FROM supplier WHERE s_suppkey % 40 BETWEEN 1 AND 20
UNION ALL SELECT 'route/' || p_partkey, 'TransitRoute', CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END FROM part""")
def transit_nodes(s: SparkSession, d: str) -> DataFrame:
    k = C("s_suppkey") % 40
    stops = load(s, d, "supplier").select(C("s_suppkey").cast("string").alias("stop_id"), C("s_name").alias("stop_name"), *[F.lit("").alias(c) for c in ("stop_code", "platform_code", "wheelchair_boarding")], F.when((k >= 1) & (k <= 20), "51.5").when(k == 0, "x").otherwise("52.5").alias("stop_lat"), F.lit("7.5").alias("stop_lon"))
    routes = load(s, d, "part").select(C("p_partkey").cast("string").alias("route_id"), C("p_brand").alias("route_short_name"), F.when(C("p_partkey") % 2 == 0, C("p_name")).otherwise("").alias("route_long_name"), F.lit("3").alias("route_type"), F.lit("a").alias("agency_id"))
    return feeds.gtfs_static(feeds.gtfs_stops(stops), routes, now()).select("source_id", "node_type", "label")


@query("disruption_nodes", "SELECT event_id::VARCHAR AS source_id, event_id % 1000 AS delay_s FROM events WHERE event_id % 1000 >= 600 OR event_type = 'click'")
def disruption_nodes(s: SparkSession, d: str) -> DataFrame:
    raw = load(s, d, "events").select(F.when(C("event_type") == "click", "alert").otherwise("delay").alias("kind"), C("event_id").cast("string").alias("source_id"), C("event_type").alias("label"), C("props").alias("description"), C("ts").cast("timestamp").alias("valid_from"), F.array(F.lit("r")).alias("route_ids"), (C("event_id") % 1000).cast("int").alias("delay_s"))
    return feeds.gtfs_realtime(raw, now()).select("source_id", prop("delay_s").cast("long").alias("delay_s"))


@query("air_nodes", """WITH h AS (SELECT strftime(o_orderdate, '%d.%m.%Y') AS day, max(o_orderkey) AS k, max(o_orderdate::DATE) AS dt FROM orders GROUP BY 1), l AS (SELECT * FROM h ORDER BY dt DESC LIMIT 1)
SELECT 'VDOM|' || day || '|24:00' AS source_id, 'Air quality VDOM ' || day || ' 24:00' AS label, epoch_us(dt::TIMESTAMP) // 1000000 + 86400 AS from_s, 51.52355::DOUBLE AS lat, 7.48356::DOUBLE AS lon, (k % 90) / 10.0::DOUBLE AS pm10, NULL::DOUBLE AS no2, (k % 80)::DOUBLE AS no, (k % 70)::DOUBLE AS so2, (k % 60)::DOUBLE AS o3 FROM l
UNION ALL SELECT 'DMD2|' || day || '|24:00', 'Air quality DMD2 ' || day || ' 24:00', epoch_us(dt::TIMESTAMP) // 1000000 + 86400, 51.53689::DOUBLE, 7.45741::DOUBLE, NULL, (k % 50)::DOUBLE, NULL, NULL, NULL FROM l""")
def air_nodes(s: SparkSession, d: str) -> DataFrame:
    k = C("k")
    day = load(s, d, "orders").groupBy(F.date_format("o_orderdate", "dd.MM.yyyy").alias("Datum")).agg(F.max("o_orderkey").alias("k"))
    head = lambda st, what: f"{st} {what} 1H Mittelwert [µg/m³]"
    text = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    wide = day.select(
        "Datum", F.lit("24:00").alias("Zeit"), text((k % 90) / 10.0).alias(head("VDOM", "PM10F")), F.lit("<7").alias(head("VDOM", "NO2")), text(k % 80).alias(head("VDOM", "NO")), text(k % 70).alias(head("VDOM", "SO2")),
        text(k % 60).alias(head("VDOM", "O3")), F.lit("3").alias(head("VDOM", "Wind")), text(k % 50).alias(head("DMD2", "NO2")), F.lit("9").alias(head("ELSE", "NO2")),
    )
    n = feeds.lanuv_air(wide, now())
    return n.select("source_id", "label", F.unix_seconds("valid_from").alias("from_s"), "lat", "lon", *[prop(m).cast("double").alias(m) for m in ("pm10", "no2", "no", "so2", "o3")])


@query("council_nodes", """SELECT CASE c_custkey % 3 WHEN 0 THEN 'Organization' WHEN 1 THEN 'Person' ELSE 'Meeting' END AS node_type, 'u' || c_custkey AS source_id, c_name AS label, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS party FROM customer WHERE c_custkey % 10 <> 9
UNION ALL SELECT 'AgendaItem', 'a' || c_custkey, 'Punkt', NULL FROM customer WHERE c_custkey % 3 = 2 AND c_custkey % 10 <> 9
UNION ALL SELECT 'Resolution', 'r' || c_custkey, 'Beschluss', NULL FROM customer WHERE c_custkey % 3 = 2 AND c_custkey % 10 <> 9""")
def council_nodes(s: SparkSession, d: str) -> DataFrame:
    return _oparl(s, d)[0].select("node_type", "source_id", "label", prop("party").alias("party"))


@query("council_edges", "SELECT sha256('council_oparl|r' || c_custkey) AS from_node_id, sha256('council_oparl|u' || (c_custkey - 2)) AS to_node_id FROM customer WHERE c_custkey % 3 = 2 AND c_custkey % 10 <> 9 AND (c_custkey - 2) % 10 <> 9 AND c_custkey - 2 IN (SELECT c_custkey FROM customer)")
def council_edges(s: SparkSession, d: str) -> DataFrame:
    return _oparl(s, d)[1].select("from_node_id", "to_node_id")


def _oparl(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Customers as committees, members and meetings by turns; a tenth is deleted."""
    k = C("c_custkey")
    ident = lambda p, by=0: F.concat(F.lit(p), (k - by).cast("string"))
    null = F.lit(None).cast("string")
    kind = F.when(k % 3 == 0, "Organization").when(k % 3 == 1, "Person").otherwise("Meeting")
    org = lambda c, n: F.struct(F.struct(F.lit(c).alias("classification"), n.alias("shortName"), null.alias("name")).alias("organization"))
    decision = F.struct(ident("r").alias("id"), F.lit("Beschluss").alias("name"), F.lit("7").alias("resolutionNumber"))
    item = F.struct(ident("a").alias("id"), F.lit("1").alias("number"), F.lit("Punkt").alias("name"), F.lit(True).alias("public"), F.array(decision).alias("resolution"))
    data = F.struct(ident("u").alias("id"), C("c_name").alias("name"), null.alias("modified"), (k % 10 == 9).alias("deleted"), null.alias("organizationType"), null.alias("title"), F.array(org("committee", F.lit("x")), org("party", C("c_mktsegment"))).alias("membership"), null.alias("start"), null.alias("end"), F.array(ident("u", 2)).alias("organization"), F.array(item).alias("agendaItem"))
    return council.oparl(load(s, d, "customer").select(kind.alias("oparl_type"), data.alias("data")), now())
