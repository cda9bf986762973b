"""Areas, places, streets and construction sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import iso_time, stable_id, text_or
from tessera.sources.common import emit, part_of

C = F.col


def geo_spine(raw: DataFrame, now: Column) -> DataFrame:
    """Districts and sub-districts; a sub-district carries its district's key. Other datasets emit nothing."""
    r = raw.filter(C("dataset").isin("stadtbezirke", "stat_bezirke"))
    top = C("dataset") == "stadtbezirke"
    nr = F.when(top, C("record.stadtbezirk_nr")).otherwise(C("record.statistischer_bezirk_nr"))
    label = F.when(top, C("record.stadtbezirk_bezeichnung")).otherwise(C("record.statistischer_bezirk"))
    props = {"area_type": F.when(top, "stadtbezirk").otherwise("statistischer_bezirk"), "_parent_source_id": F.when(~top, F.nullif(C("record.stadtbezirk_nr"), F.lit("")))}
    return emit(r, "GeoArea", "geo_spine", F.coalesce(nr, F.lit("")), F.coalesce(label, F.lit("Unknown")), props, now, rings=C("record.geografische_polygone.geometry.coordinates"))


def area_hierarchy(areas: DataFrame, now: Column) -> DataFrame:
    """PART_OF from sub-districts to their districts; those without a known district have none (``linking.orphans`` lists them)."""
    kind, parent = F.get_json_object("properties", "$.area_type"), F.get_json_object("properties", "$._parent_source_id")
    a = areas.withColumns({"__kind": kind, "__parent": parent})
    return part_of(a.filter("__kind = 'statistischer_bezirk'"), "__parent", a.filter("__kind = 'stadtbezirk'"), "source_id", "geo_spine", now)


def overpass(raw: DataFrame, now: Column) -> DataFrame:
    """Map elements: ways lie at their centre; the label falls back to brand, operator, then type and id."""
    tag = lambda k: F.nullif(F.try_element_at("tags", F.lit(k)), F.lit(""))
    sid = F.concat_ws("/", "type", C("id").cast("string"))
    label = F.coalesce(tag("name"), tag("brand"), tag("operator"), F.concat_ws(" ", F.lit("OSM"), "type", C("id").cast("string")))
    way = C("type") == "way"
    props = {k: tag(k) for k in ("amenity", "shop", "office", "leisure", "tourism", "opening_hours")}
    props |= {k: F.coalesce(tag(k), tag(f"contact:{k}")) for k in ("phone", "website")} | {f"addr_{k}": tag(f"addr:{k}") for k in ("street", "housenumber", "postcode")}
    return emit(raw, "POI", "osm_overpass", sid, label, props, now, F.concat(F.lit("https://www.openstreetmap.org/"), sid), lat=F.when(way, C("center.lat")).otherwise(C("lat")), lon=F.when(way, C("center.lon")).otherwise(C("lon")))


def ods_pois(raw: DataFrame, now: Column) -> DataFrame:
    """Civic places of the open-data portal."""
    name = text_or(C("objektname"), "Unbenannt")
    sid = stable_id(F.coalesce("_dataset", F.lit("")), name, C("geo_point_2d.lon"), C("geo_point_2d.lat"))
    props = {"poi_type": C("_poi_type"), "objektart": C("objektart"), "addr_street": C("strasse"), "addr_housenumber": C("hausnummer"), "stadtbezirk": C("stadtbezbe"), "stat_bezirk": C("statbezibe"), "website": C("link"), "info": F.nullif(C("i_zusinfo"), F.lit(""))}
    return emit(raw, "POI", "opendata_pois", sid, name, props, now, lat=C("geo_point_2d.lat"), lon=C("geo_point_2d.lon"))


def ods_stats(raw: DataFrame, now: Column) -> DataFrame:
    """Demographics of districts, valid from 1 January of their year."""
    nr = F.coalesce("stadtbezirk_nr", F.lit(""))
    values = ("durchschnittsalter", "minderjahrigenanteil", "altenanteil", "hochbetagtenanteil")
    props = {"area_type": F.lit("stadtbezirk_demographics"), "stadtbezirk": text_or(C("stadtbezirk"), "Unbekannt"), "stadtbezirk_nr": nr, "year": C("_year")} | {v: C(v) for v in values}
    label = F.concat(text_or(C("stadtbezirk"), "Unbekannt"), F.lit(" Demografie "), F.coalesce(C("_year").cast("string"), F.lit("None")))
    return emit(raw, "GeoArea", "opendata_demographics", stable_id(F.coalesce("_dataset", F.lit("")), nr), label, props, now, valid_from=F.make_timestamp(C("_year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def strassen(raw: DataFrame, now: Column) -> DataFrame:
    """The street register, without geometry. Columns that a register lacks are null."""
    have = lambda c: C(c) if c in raw.columns else F.lit(None).cast("string")
    name, key = text_or(C("strassenname"), "Unbenannte Straße"), F.coalesce("strassenschlussel", F.lit(""))
    props = {"road_type": F.lit("street"), "name_de": name, "strassenschlussel": key, "stat_bezirk_nr": have("statistischer_bezirk_nr"), "stat_bezirk": have("statistischer_bezirk_bezeichnung"), "stadtbezirk_nr": have("stadtbezirk_nr"), "stadtbezirk": have("stadtbezirk_bezeichnung")}
    return emit(raw, "Road", "street_register", F.coalesce(F.nullif(key, F.lit("")), name), name, props, now)


def strassenabschnitte(raw: DataFrame, now: Column) -> DataFrame:
    """Street segments with their line; the line is the only ring, its first point the position."""
    key, part = F.coalesce("strassenschlussel", F.lit("")), F.coalesce("strassenabschnittsnummer", F.lit(""))
    name, line = text_or(C("strassenname"), "Unbenannter Abschnitt"), C("geo_shape.geometry.coordinates")
    props = {"road_type": text_or(C("strassenklasse"), "segment"), "name_de": name, "strassenschlussel": key, "abschnitt": part, "length_m": C("lange_strassenabschnitt_m").try_cast("double").cast("int"), "strassengruppe": C("strassengruppe")}
    return emit(raw, "Road", "street_segments", F.concat_ws("-", key, part), name, props, now, rings=F.when(line.isNotNull(), F.array(line)), lon=F.get(F.get(line, F.lit(0)), F.lit(0)), lat=F.get(F.get(line, F.lit(0)), F.lit(1)))


def baustellen(raw: DataFrame, now: Column) -> DataFrame:
    """Construction sites with begin and planned end."""
    art, von, bis = text_or(C("art_der_baumassnahme"), "Baustelle"), F.coalesce("von", F.lit("")), F.coalesce("bis", F.lit(""))
    lon, lat = C("geografische_koordinate.lon"), C("geografische_koordinate.lat")
    props = {"reason": art, "operator": C("auftraggeber"), "planned_end": F.nullif(bis, F.lit("")), "stadtbezirk": C("stadtbezirk"), "einschrankung": C("einschrankung")}
    return emit(raw, "ConstructionSite", "construction_sites", stable_id(art, von, lon, lat), F.substring(art, 1, 120), props, now, valid_from=iso_time(von), valid_to=iso_time(bis), lat=lat, lon=lon)
