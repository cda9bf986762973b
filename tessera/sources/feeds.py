"""Weather, air, police, events, tenders, transit and motorway traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geo import in_box
from tessera.functions.scalars import date_and_clock, decimal_comma, epoch_time, first_tag, iso_time, iso_time_or_date, rfc_time, stable_id, tag_by_parent, text_or
from tessera.functions.text import classify_report, strip_html
from tessera.sources.common import emit

C = F.col
# The city's position and extent (least and greatest latitude, least and greatest longitude).
HOME_LAT, HOME_LON = 51.5136, 7.4653
BOX = (51.41, 51.60, 7.30, 7.64)


def brightsky(raw: DataFrame, now: Column) -> DataFrame:
    """Weather observations at their station, or at the city's position where the station has none."""
    station, ts = F.coalesce("_source.dwd_station_id", F.lit("")), F.coalesce("timestamp", F.lit(""))
    props = {c: C(c) for c in ("temperature", "precipitation", "wind_speed", "condition")} | {"station_id": C("_source.id"), "dwd_station_id": F.nullif(station, F.lit(""))}
    label = F.concat_ws(" ", F.lit("Weather"), text_or(C("_source.station_name"), "Dortmund"), ts)
    return emit(raw, "WeatherObservation", "brightsky", F.concat_ws("|", station, ts), label, props, now, valid_from=iso_time(ts), lat=F.coalesce("_source.lat", F.lit(HOME_LAT)), lon=F.coalesce("_source.lon", F.lit(HOME_LON)))


def polizei_rss(raw: DataFrame, now: Column) -> DataFrame:
    """Press releases, classified by their words. Landed RSS is read with ``format("xml"), rowTag="item"``."""
    guid = F.coalesce(F.nullif(F.trim("guid"), F.lit("")), F.trim("link"), F.lit(""))
    text = F.coalesce(strip_html(C("description")), F.lit(""))
    props = {"event_type": classify_report(C("title"), text), "description": text, "tags": F.array(F.lit("polizei"))}
    return emit(raw, "Event", "police_rss", F.substring(F.sha2(guid, 256), 1, 20), text_or(F.trim("title"), "Polizeimeldung"), props, now, F.nullif(F.trim("link"), F.lit("")), valid_from=rfc_time(C("pubDate")))


def city_events(raw: DataFrame, now: Column) -> DataFrame:
    """Public events of the calendar's search hits; hits of other types, or without content, title or id, emit nothing."""
    d = F.get("content", F.lit(0))["data"]
    x = raw.withColumn("d", d).filter("type = 'eventdatetime' and d.event.title <> '' and id <> ''")
    url = F.when(C("website_url").startswith("/"), F.concat(F.lit("https://www.dortmund.de"), C("website_url"))).otherwise(C("website_url"))
    flags = {"is_cancelled": "isCancelled", "is_sold_out": "isSoldOut", "free_of_charge": "freeOfCharge"}
    props = {
        "event_type": F.lit("public_event"), "category": tag_by_parent(C("contentTags"), "Veranstaltungskalender"), "stadtbezirk": tag_by_parent(C("contentTags"), "Stadtbezirke"),
        "description": strip_html(F.coalesce(F.nullif(C("d.event.description"), F.lit("")), C("d.event.text"))), **{k: F.coalesce(C(f"d.{v}"), F.lit(False)) for k, v in flags.items()}, "tags": F.array(F.lit("veranstaltung")),
    }
    return emit(x, "Event", "city_events", C("id"), C("d.event.title"), props, now, url, valid_from=iso_time_or_date(F.coalesce(F.nullif(C("d.startDateTime"), F.lit("")), C("d.startCalendarDay.date"))))


# Notice subtypes and the kinds of tender they stand for.
SUBTYPES = {"16": "works", "17": "services", "18": "supplies"}


def vergabe(raw: DataFrame, now: Column, contains: str = "Dortmund") -> DataFrame:
    """Public tenders from eForms notices (``xml``) that contain a word and have a folder id. A date with offset is that day there."""
    x = raw.filter(C("xml").contains(contains)).withColumn("folder", first_tag(C("xml"), "cbc:ContractFolderID")).filter("folder is not null")
    project = F.coalesce(first_tag(C("xml"), "cac:ProcurementProject"), F.lit(""))
    kinds = F.create_map(*[F.lit(v) for kv in SUBTYPES.items() for v in kv])
    issued = first_tag(C("xml"), "cbc:IssueDate")
    day = F.coalesce(F.regexp_replace(issued, r"^(\d{4}-\d{2}-\d{2})([+-]\d{2}:\d{2}|Z)$", "$1T00:00:00$2").try_cast("timestamp"), iso_time(issued))
    props = {
        "tender_type": F.coalesce(F.try_element_at(kinds, F.coalesce(first_tag(C("xml"), "cbc:SubTypeCode"), F.lit(""))), F.lit("other")), "cpv": first_tag(project, "cbc:ItemClassificationCode"),
        "buyer_city": first_tag(C("xml"), "cbc:CityName"), "deadline": first_tag(C("xml"), "cbc:EndDate"), "value_eur": first_tag(C("xml"), "cbc:EstimatedOverallContractAmount"),
    }
    return emit(x, "Tender", "tenders", C("folder"), F.coalesce(first_tag(project, "cbc:Name"), F.lit("Bekanntmachung")), props, now, valid_from=day)


def gtfs_stops(stops: DataFrame, box: tuple[float, float, float, float] = BOX) -> DataFrame:
    """Stops within the box, coordinates as numbers; unreadable coordinates drop out."""
    x = stops.withColumns({"lat": C("stop_lat").try_cast("double"), "lon": C("stop_lon").try_cast("double")})
    return x.filter(in_box(C("lat"), C("lon"), box))


def gtfs_routes(stops: DataFrame, stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Routes that serve the stops: semi-joins over stop times and trips."""
    times = stop_times.join(stops.select("stop_id"), "stop_id", "left_semi").select("trip_id").distinct()
    served = trips.join(times, "trip_id", "left_semi").select("route_id").distinct()
    return routes.join(served, "route_id", "left_semi")


def gtfs_static(stops: DataFrame, routes: DataFrame, now: Column) -> DataFrame:
    """Transit stops (from ``gtfs_stops``) and routes as nodes."""
    s = emit(stops, "TransitStop", "gtfs_static", F.concat(F.lit("stop/"), C("stop_id")), text_or(C("stop_name"), "Haltestelle"), {c: F.nullif(C(c), F.lit("")) for c in ("stop_code", "platform_code", "wheelchair_boarding")}, now, lat=C("lat"), lon=C("lon"))
    label = F.coalesce(F.nullif(C("route_long_name"), F.lit("")), F.nullif(C("route_short_name"), F.lit("")), C("route_id"))
    r = emit(routes, "TransitRoute", "gtfs_static", F.concat(F.lit("route/"), C("route_id")), label, {c: F.nullif(C(c), F.lit("")) for c in ("route_short_name", "route_long_name", "route_type", "agency_id")}, now)
    return s.unionByName(r)


DELAY_S = 600


def greatest_delay(stop_updates: Column) -> Column:
    """The greatest arrival or departure delay of a trip's stops; 0 if none is stated."""
    each = F.flatten(F.transform(stop_updates, lambda u: F.array(F.coalesce(u["arrival_delay"], F.lit(0)), F.coalesce(u["departure_delay"], F.lit(0)))))
    return F.coalesce(F.array_max(each), F.lit(0))


def gtfs_realtime(raw: DataFrame, now: Column) -> DataFrame:
    """Disruptions: alerts, and trips delayed by ten minutes or more (``delay_s``). Landed as JSON (the feed is protobuf)."""
    x = raw.filter("source_id is not null").filter((C("kind") != "delay") | (C("delay_s") >= DELAY_S))
    at = C("valid_from") if dict(raw.dtypes)["valid_from"].startswith("timestamp") else epoch_time(C("valid_from"))
    props = {"event_type": F.lit("transit_disruption"), "kind": C("kind"), "description": C("description"), "route_ids": F.coalesce("route_ids", F.array().cast("array<string>")), "delay_s": C("delay_s"), "tags": F.array(F.lit("transit"), F.lit("gtfs-rt"))}
    return emit(x, "Event", "gtfs_realtime", C("source_id"), C("label"), props, now, valid_from=at)


# Measured substances by the name in the table's header, and the stations of the city with their positions.
SUBSTANCES = {"PM10F": "pm10", "NO2": "no2", "NO": "no", "SO2": "so2", "O3": "o3"}
STATIONS = {
    "DOB12": (51.50058, 7.48101),
    "DOB11": (51.50404, 7.50251),
    "VDOM3": (51.52409, 7.47962),
    "VDOM": (51.52355, 7.48356),
    "DMD2": (51.53689, 7.45741),
    "DOMA": (51.52402, 7.45555),
    "DOMM": (51.50563, 7.47412),
    "DOMR": (51.50440, 7.46712),
}


def air_measures(wide: DataFrame, stations: dict[str, tuple[float, float]] = STATIONS, date: str = "Datum", clock: str = "Zeit") -> DataFrame:
    """``station, lat, lon, day, clock, observed`` and a column for each substance, from a table with a column for each ``station substance ...``.

    Which column is what is known from the header, so every row becomes its stations' rows without a shuffle.
    Columns of other stations and substances are left out; what a station doesn't measure is null.
    """
    of: dict[str, dict[str, str]] = {}
    for c in wide.columns:
        station, substance, *_ = (*c.split(), "", "")
        if station in stations and substance in SUBSTANCES:
            of.setdefault(station, {})[SUBSTANCES[substance]] = c
    value = lambda c: decimal_comma(C(f"`{c}`").cast("string")) if c else F.lit(None).cast("double")
    rows = [F.struct(F.lit(st).alias("station"), F.lit(stations[st][0]).alias("lat"), F.lit(stations[st][1]).alias("lon"), *[value(cs.get(s)).alias(s) for s in SUBSTANCES.values()]) for st, cs in of.items()]
    x = wide.select(C(date).alias("day"), C(clock).alias("clock"), date_and_clock(C(date), C(clock)).alias("observed"), *([F.inline(F.array(*rows))] if rows else []))
    if rows:
        return x
    return x.limit(0).select(*[F.lit(None).cast(t).alias(c) for c, t in (("station", "string"), ("lat", "double"), ("lon", "double"))], "day", "clock", "observed", *[F.lit(None).cast("double").alias(s) for s in SUBSTANCES.values()])


def lanuv_air(wide: DataFrame, now: Column, stations: dict[str, tuple[float, float]] = STATIONS) -> DataFrame:
    """Air quality: the table's latest hour, an observation for each station in its header, measured or not."""
    last = air_measures(wide.orderBy(F.desc_nulls_last(date_and_clock(C("Datum"), C("Zeit")))).limit(1), stations)
    day, clock = (F.coalesce(c, F.lit("")) for c in ("day", "clock"))
    props = {**{s: C(s) for s in SUBSTANCES.values()}, "station_id": C("station"), "preliminary": F.lit(True)}
    return emit(last, "AirQualityObservation", "lanuv_luqs", F.concat_ws("|", "station", day, clock), F.concat_ws(" ", F.lit("Air quality"), "station", day, clock), props, now, valid_from=C("observed"), lat=C("lat"), lon=C("lon"))


def _joined(c: Column, kind: str) -> Column:
    return F.array_join(c, " ") if kind.startswith("array") else c


def autobahn(raw: DataFrame, now: Column, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Motorway messages: road works are construction sites, all else events. Titles may be lists or texts."""
    types = dict(raw.dtypes)
    x = raw if box is None else raw.filter(in_box(C("_lat"), C("_lon"), box))
    text = {c: F.nullif(_joined(C(c), types[c]), F.lit("")) for c in ("title", "subtitle", "description")}
    work = C("_kind") == "roadwork"
    props = {
        "event_type": F.when(~work, F.when(C("_kind") == "closure", "road_closure").otherwise("traffic_disruption")), "reason": F.when(work, text["subtitle"]), "operator": F.when(work, "Autobahn GmbH"), "road": C("_road"),
        "subtitle": F.when(~work, text["subtitle"]), "description": text["description"], "is_blocked": F.coalesce("isBlocked", F.lit(False)), "tags": F.when(~work, F.array(F.lit("verkehr"), F.lit("autobahn"), C("_road"))),
    }
    label = F.coalesce(text["title"], F.concat_ws(" ", "_road", "_kind"))
    return emit(x, F.when(work, "ConstructionSite").otherwise("Event"), "autobahn", C("identifier"), label, props, now, valid_from=iso_time(C("startTimestamp")), lat=C("_lat"), lon=C("_lon"))
