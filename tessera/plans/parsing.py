"""Queries on the sources' parsers, run on the texts of the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars, text
from tessera.plans import world as w
from tessera.sources import council, feeds, places
from tessera.storage import load

QUERIES: dict = {}
SQL: dict = {}
C = F.col
def now() -> Column:
    return F.lit("2026-01-01T00:00:00Z").cast("timestamp")



def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("overpass_nodes", f"WITH {w.OSM} SELECT id, label, shop, amenity, lat, lon FROM osm")
def overpass_nodes(s: SparkSession, d: str) -> DataFrame:
    p = lambda k: F.get_json_object("properties", f"$.{k}").alias(k)
    return w.osm(s, d).select("id", "label", p("shop"), p("amenity"), "lat", "lon")


@query("autobahn_nodes", f"WITH {w.TRAFFIC} SELECT id, node_type, label FROM traffic")
def autobahn_nodes(s: SparkSession, d: str) -> DataFrame:
    return w.traffic(s, d).select("id", "node_type", "label")


@query("meeting_nodes", r"""SELECT DISTINCT substr(sha256(coalesce(datum, '') || '|' || g || '|' || coalesce(beginn, '00:00:00')), 1, 20) AS source_id, substr(g || ' ' || coalesce(datum, ''), 1, 200) AS label FROM (SELECT *, coalesce(nullif(gremium, ''), 'Unbekanntes Gremium') AS g FROM gremientermine)""")
def meeting_nodes(s: SparkSession, d: str) -> DataFrame:
    return council.gremientermine(load(s, d, "gremientermine"), now()).select("source_id", "label").distinct()


@query("weather_nodes", """SELECT DISTINCT coalesce(_source.dwd_station_id, '') || '|' || coalesce("timestamp", '') AS source_id, substr('Weather ' || coalesce(nullif(_source.station_name, ''), 'Dortmund') || ' ' || coalesce("timestamp", ''), 1, 200) AS label, coalesce(_source.lat, 51.5136) AS lat, coalesce(_source.lon, 7.4653) AS lon FROM brightsky""")
def weather_nodes(s: SparkSession, d: str) -> DataFrame:
    return feeds.brightsky(load(s, d, "brightsky"), now()).select("source_id", "label", "lat", "lon").distinct()


@query("area_nodes", f"WITH {w.AREAS} SELECT id, label, area_type, parent FROM areas")
def area_nodes(s: SparkSession, d: str) -> DataFrame:
    return w.areas(s, d).select("id", "label", F.get_json_object("properties", "$.area_type").alias("area_type"), F.get_json_object("properties", "$._parent_source_id").alias("parent"))


@query("stable_source_id", f"WITH {w.ODS} SELECT DISTINCT source_id, label FROM ods")
def stable_source_id(s: SparkSession, d: str) -> DataFrame:
    return places.ods_pois(load(s, d, "ods_pois"), now()).select("source_id", "label").distinct()


@query("parse_timestamps", r"""SELECT obs_id, CASE WHEN regexp_matches(t, '^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,9})?)?\s*(Z|[+-]\d\d:?\d\d)?)?$') THEN
  epoch_us(try_cast(t[1:10] AS DATE)::TIMESTAMP) + CASE WHEN length(t) = 10 THEN 0 WHEN t[12:13]::INT < 24 AND t[15:16]::INT < 60 AND coalesce(nullif(regexp_extract(t, '^.{16}:(\d\d)', 1), ''), '0')::INT < 60 THEN
    (t[12:13]::BIGINT * 3600 + t[15:16]::BIGINT * 60 + coalesce(nullif(regexp_extract(t, '^.{16}:(\d\d)', 1), ''), '0')::BIGINT) * 1000000 + rpad(regexp_extract(t, '^.{19}\.(\d+)', 1), 6, '0')[1:6]::BIGINT
    - CASE WHEN regexp_matches(t, '[+-]\d\d:?\d\d$') AND length(t) > 16 THEN (CASE WHEN regexp_extract(t, '([+-])\d\d:?\d\d$', 1) = '-' THEN -1 ELSE 1 END) * (regexp_extract(t, '(\d\d):?\d\d$', 1)::BIGINT * 60 + right(t, 2)::BIGINT) * 60000000 ELSE 0 END END END AS utc_us
FROM (SELECT obs_id, trim("timestamp", ' ') AS t FROM brightsky)""")
def parse_timestamps(s: SparkSession, d: str) -> DataFrame:
    """Every row: what isn't ISO is null."""
    return load(s, d, "brightsky").select("obs_id", F.unix_micros(scalars.iso_time(C("timestamp"))).alias("utc_us"))


@query("rollover_timestamp", r"""SELECT obs_id, CASE WHEN regexp_matches(d, '^\d\d\.\d\d\.\d{4}$') AND regexp_matches(k, '^\d{1,2}:\d\d$') AND split_part(k, ':', 1)::INT <= 24 AND right(k, 2)::INT < 60 THEN epoch_us(try_strptime(d, '%d.%m.%Y')) // 1000000 + split_part(k, ':', 1)::BIGINT * 3600 + right(k, 2)::BIGINT * 60 END AS at_s
FROM (SELECT obs_id, split_part("timestamp", ' ', 1) AS d, regexp_extract("timestamp", '([^ ]*)$', 1) AS k FROM brightsky)""")
def rollover_timestamp(s: SparkSession, d: str) -> DataFrame:
    """Every row: what isn't a German date with a clock is null."""
    t = C("timestamp")
    return load(s, d, "brightsky").select("obs_id", F.unix_seconds(scalars.date_and_clock(F.substring_index(t, " ", 1), F.substring_index(t, " ", -1))).alias("at_s"))


@query("strip_html", r"SELECT doc_id, nullif(trim(regexp_replace(coalesce(text, ''), '<[^>]+>', '', 'g'), ' '), '') AS plain FROM documents")
def strip_html(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", text.strip_html(C("text")).alias("plain"))


@query("html_text")
def html_text(s: SparkSession, d: str) -> DataFrame:
    """Markup to text with its entities resolved; the entities have no SQL function."""
    return load(s, d, "documents").select("doc_id", text.html_to_text(C("text")).alias("plain"))


@query("classify_text", """SELECT doc_id, CASE WHEN regexp_matches(t, 'versammlung|demonstration|kundgebung|aufzug') THEN 'demonstration' WHEN regexp_matches(t, 'unfall|verkehr|kollision') THEN 'traffic_accident' WHEN regexp_matches(t, 'razzia|durchsuchung|festnahme') THEN 'police_operation' ELSE 'police_report' END AS kind FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)""")
def classify_text(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", text.classify_report(F.lit(""), C("text")).alias("kind"))


@query("xml_extract", """SELECT o_orderkey, o_orderpriority AS name, CASE o_orderkey % 4 WHEN 0 THEN 'works' WHEN 1 THEN 'services' WHEN 2 THEN 'supplies' ELSE 'other' END AS tender_type FROM orders""")
def xml_extract(s: SparkSession, d: str) -> DataFrame:
    """Notices written as XML and read back by the tender source."""
    o = load(s, d, "orders")
    code = (C("o_orderkey") % 4 + 16).cast("string")
    xml = F.concat(F.lit("<n><cbc:ContractFolderID schemeName='x'>"), C("o_orderkey").cast("string"), F.lit("</cbc:ContractFolderID>\n<cac:ProcurementProject>\n<cbc:Name languageID='DEU'>"), "o_orderpriority", F.lit("</cbc:Name></cac:ProcurementProject><cbc:SubTypeCode>"), code, F.lit("</cbc:SubTypeCode> Dortmund</n>"))
    t = feeds.vergabe(o.select(xml.alias("xml")), now())
    return t.select(C("source_id").cast("long").alias("o_orderkey"), C("label").alias("name"), F.get_json_object("properties", "$.tender_type").alias("tender_type"))


@query("url_param", "SELECT doc_id, doc_id::VARCHAR AS found FROM documents")
def url_param(s: SparkSession, d: str) -> DataFrame:
    link = F.concat(F.lit("https://example.org/doc?lang=de&documentId="), C("doc_id").cast("string"), F.lit("&x=1"))
    return load(s, d, "documents").select("doc_id", scalars.url_parameter(link, "documentId").alias("found"))


@query("wide_to_map", """SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN round(l_discount * 100) <> 0 THEN 'discount=' || round(l_discount * 100)::INT END, CASE WHEN l_quantity <> 0 THEN 'quantity=' || l_quantity::INT END, CASE WHEN round(l_tax * 100) <> 0 THEN 'tax=' || round(l_tax * 100)::INT END) AS pairs FROM lineitem""")
def wide_to_map(s: SparkSession, d: str) -> DataFrame:
    m = council.wide_to_map({"discount": F.round(C("l_discount") * 100).cast("int"), "quantity": C("l_quantity").cast("int"), "tax": F.round(C("l_tax") * 100).cast("int")})
    pairs = F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return load(s, d, "lineitem").select("l_orderkey", "l_linenumber", pairs.alias("pairs"))


@query("safe_ratio", "SELECT p_partkey, round(100.0 * nullif(p_size, 0) / nullif(p_size + p_partkey % 7, 0), 2)::DOUBLE AS pct FROM part")
def safe_ratio(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "part").select("p_partkey", scalars.share_pct(C("p_size"), C("p_size") + C("p_partkey") % 7).cast("double").alias("pct"))


@query("pivot_measures", """SELECT strftime(o_orderdate, '%d.%m.%Y') AS day, o_orderkey % 24 AS hour, x.station, x.no2, x.pm10, x.o3 FROM orders,
LATERAL (SELECT 'VDOM' AS station, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 90) / 10.0 END::DOUBLE AS no2, ((o_orderkey % 50) + 0.5)::DOUBLE AS pm10, NULL::DOUBLE AS o3
         UNION ALL SELECT 'DOMA', NULL, NULL, (o_orderkey % 70)::DOUBLE) x""")
def pivot_measures(s: SparkSession, d: str) -> DataFrame:
    """A wide table of decimal commas as rows of its known stations; other stations and substances are left out."""
    k = C("o_orderkey")
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    head = lambda st, what: f"{st} {what} 1H Mittelwert [µg/m³]"
    wide = load(s, d, "orders").select(
        F.date_format("o_orderdate", "dd.MM.yyyy").alias("Datum"), F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00")).alias("Zeit"), F.when(k % 3 == 0, "<7").otherwise(comma((k % 90) / 10.0)).alias(head("VDOM", "NO2")),
        comma((k % 50) + F.lit(0.5)).alias(head("VDOM", "PM10F")), F.lit("1").alias(head("VDOM", "Wind")), (k % 70).cast("string").alias(head("DOMA", "O3")), F.lit("5").alias(head("XYZ", "NO2")),
    )
    return feeds.air_measures(wide).select("day", F.substring("clock", 1, 2).cast("bigint").alias("hour"), "station", "no2", "pm10", "o3")


@query("nested_first_match", "SELECT source_id, objektart AS found FROM ods_pois")
def nested_first_match(s: SparkSession, d: str) -> DataFrame:
    tag = lambda v, p: F.struct(v.alias("value"), F.array(F.lit(p)).alias("parentValues"))
    tags = F.array(tag(C("_dataset"), "Datensatz"), tag(C("objektart"), "Art"), tag(C("objektname"), "Art"))
    return load(s, d, "ods_pois").select("source_id", scalars.tag_by_parent(tags, "Art").alias("found"))


@query("max_delay_threshold", "SELECT l_orderkey, max((l_quantity * 20)::INT) AS delay_s FROM lineitem GROUP BY 1 HAVING max((l_quantity * 20)::INT) >= 600")
def max_delay_threshold(s: SparkSession, d: str) -> DataFrame:
    late = (C("l_quantity") * 20).cast("int")
    u = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(late.alias("arrival_delay"), F.lit(None).cast("int").alias("departure_delay"))).alias("u"))
    return u.select("l_orderkey", feeds.greatest_delay(C("u")).alias("delay_s")).filter(C("delay_s") >= feeds.DELAY_S)


def _minutes(s: SparkSession, d: str) -> DataFrame:
    """Council texts as landed minutes."""
    x = load(s, d, "documents").filter("source = 'gremienniederschriften'")
    # Their lines say "TOP 1.2 ..." and "Vorlage Nr. 12345-18"; minutes have the bare number and "Drucksache Nr.".
    html = F.regexp_replace(F.regexp_replace("text", r"(?m)^TOP (\d)", "$1"), r"Vorlage Nr\. (\d)", "Drucksache Nr.: $1")
    return council.minutes(x.select(F.concat(F.lit("https://example.org/?documentId="), C("doc_id").cast("string")).alias("link"), F.lit("Rat").alias("gremium"), F.date_format("published_at", "yyyy-MM-dd").alias("datum"), F.regexp_replace(html, "\n", "<br>").alias("html")))


# Lines, the items they open and the decisions behind each paper, set-wise.
_AGENDA = r"""
doc AS (
  SELECT doc_id::VARCHAR AS document_id, strftime(published_at, '%Y-%m-%d') AS datum,
    replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^TOP (\d)', '\1', 'g'), 'Vorlage Nr\. (\d)', 'Drucksache Nr.: \1', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</(p|div|tr|td|font|li|h\d)>', chr(10), 'g'), '<[^>]+>', '', 'g'),
      '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t
  FROM documents WHERE source = 'gremienniederschriften'
), lines AS (
  SELECT document_id, datum, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM doc WHERE t IS NOT NULL
), opened AS (
  SELECT *, sum(CASE WHEN regexp_matches(line, '^\d+(\.\d+){0,3}\s+\S') AND length(regexp_extract(line, '^(\d+(?:\.\d+){0,3})\s', 1)) <= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY i) AS pos
  FROM (SELECT * EXCLUDE x, trim(regexp_replace(x, '\s+', ' ', 'g'), ' ') AS line FROM lines)
), items AS (
  SELECT document_id, datum, pos, regexp_extract(first(line ORDER BY i), '^(\d+(?:\.\d+){0,3})\s+', 1) AS number, substr(regexp_extract(first(line ORDER BY i), '^(?:\d+(?:\.\d+){0,3})\s+(\S.*)$', 1), 1, 200) AS title,
    list_sort(list_distinct(flatten(list(regexp_extract_all(line, '(?i)(?:Dr\.|Drucksache)\s*Nr\.?:?\s*(\d{3,}-\d{2})', 1))))) AS papers
  FROM opened WHERE pos > 0 GROUP BY document_id, datum, pos
), flat AS (SELECT document_id, trim(regexp_replace(t, '\s+', ' ', 'g'), ' ') AS f FROM doc WHERE t IS NOT NULL),
said AS (
  SELECT document_id, nr, nullif(lower(regexp_extract(split_part(substr(behind, 1, 250), '. ', 1), '(?i)(einstimmig|mehrheitlich|abgelehnt|zugestimmt|genehmigt|beschlossen)', 1)), '') AS vote, k
  FROM (SELECT document_id, unnest(regexp_extract_all(f, '(?i)(?:Dr\.|Drucksache)\s*Nr\.?:?\s*(\d{3,}-\d{2})', 1)) AS nr, unnest(string_split_regex(f, '(?i)(?:Dr\.|Drucksache)\s*Nr\.?:?\s*\d{3,}-\d{2}')[2:]) AS behind, generate_subscripts(regexp_extract_all(f, '(?i)(?:Dr\.|Drucksache)\s*Nr\.?:?\s*(\d{3,}-\d{2})', 1), 1) AS k FROM flat)
), votes AS (SELECT document_id, nr, first(vote ORDER BY k) FILTER (vote IS NOT NULL) AS vote FROM said GROUP BY ALL),
papers AS (SELECT i.*, v.vote FROM (SELECT document_id, datum, pos, number, title, unnest(papers) AS nr FROM items) i LEFT JOIN votes v USING (document_id, nr))
"""


@query("parse_agenda", f"""WITH {_AGENDA} SELECT i.document_id, i.number, i.title, count(p.nr) AS papers, coalesce(string_agg(p.nr || '=' || coalesce(p.vote, '?') || '=' || CASE WHEN p.vote IS NULL THEN '?' WHEN p.vote = 'abgelehnt' THEN 'false' ELSE 'true' END, ',' ORDER BY p.nr), '') AS outcomes
FROM items i LEFT JOIN papers p USING (document_id, pos) GROUP BY i.document_id, i.pos, i.number, i.title""")
def parse_agenda(s: SparkSession, d: str) -> DataFrame:
    said = F.transform("i.papers", lambda p: F.concat_ws("=", p["nr"], F.coalesce(p["vote"], F.lit("?")), F.coalesce(p["passed"].cast("string"), F.lit("?"))))
    return _minutes(s, d).select("document_id", F.explode_outer("agenda").alias("i")).filter("i is not null").select("document_id", "i.number", "i.title", F.size("i.papers").cast("bigint").alias("papers"), F.array_join(said, ",").alias("outcomes"))


@query("single_outcome", f"""WITH {_AGENDA}, last AS (SELECT document_id, number, max(pos) AS pos FROM items GROUP BY ALL)
SELECT document_id || '#' || number AS source_id, CASE WHEN count(DISTINCT vote) = 1 THEN max(vote) END AS result FROM last LEFT JOIN (SELECT document_id, pos, vote FROM papers) p USING (document_id, pos) GROUP BY document_id, number""")
def single_outcome(s: SparkSession, d: str) -> DataFrame:
    n, _ = council.niederschriften(_minutes(s, d), now())
    return n.filter("node_type = 'AgendaItem'").select("source_id", F.get_json_object("properties", "$.result").alias("result"))


@query("agenda_edges", f"""WITH {_AGENDA} SELECT DISTINCT 'RELATES_TO' AS edge_type, sha256('council_minutes|' || document_id || '#' || number) AS from_node_id, sha256('council_minutes|' || document_id) AS to_node_id, 'agenda_of' AS relation FROM items
UNION ALL SELECT DISTINCT 'RELATES_TO', sha256('council_minutes|' || nr), sha256('council_minutes|' || document_id || '#' || number), 'decided_in' FROM papers""")
def agenda_edges(s: SparkSession, d: str) -> DataFrame:
    _, e = council.niederschriften(_minutes(s, d), now())
    return e.select("edge_type", "from_node_id", "to_node_id", F.get_json_object("properties", "$.relation").alias("relation"))


@query("resolution_outcomes", f"""WITH {_AGENDA} SELECT nr, CASE WHEN vote IS NULL THEN NULL ELSE vote <> 'abgelehnt' END AS passed, vote FROM (SELECT *, row_number() OVER (PARTITION BY nr ORDER BY datum DESC, document_id DESC, number DESC, title DESC) AS n FROM papers) WHERE n = 1""")
def resolution_outcomes(s: SparkSession, d: str) -> DataFrame:
    """One decision for each paper, the latest document's, with what was said of it and whether it passed."""
    n, _ = council.niederschriften(_minutes(s, d), now())
    p = lambda k: F.get_json_object("properties", f"$.{k}")
    return n.filter("node_type = 'Resolution'").select(C("source_id").alias("nr"), p("passed").cast("boolean").alias("passed"), p("vote").alias("vote"))
