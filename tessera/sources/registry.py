"""The catalogue of sources: shape, schedule and whether they run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (name, shape, schedule, description, enabled).
SOURCES = (
    ("geo_spine", "reference", "0 3 1 * *", "Districts and sub-districts", True),
    ("overpass", "reference", "0 4 * * 3", "Map elements: shops, offices, amenities", True),
    ("oparl", "event_stream", "0 6 * * *", "Council objects by OParl", False),
    ("gremientermine", "snapshot", "30 6 * * *", "Scheduled committee meetings", True),
    ("gremienniederschriften", "event_stream", "45 6 * * *", "Minutes with agenda and decisions", True),
    ("wahlergebnisse", "reference", "0 4 4 * *", "Election results and seats", True),
    ("wahlergebnisse_stimmbezirk", "reference", "30 4 4 * *", "Election results by precinct", True),
    ("brightsky", "snapshot", "5 * * * *", "Weather", True),
    ("polizei_rss", "event_stream", "25 * * * *", "Police press releases", True),
    ("dortmund_events", "reference", "0 8 * * *", "Public events", True),
    ("baustellen", "snapshot", "0 5 * * *", "Construction sites", True),
    ("ods_pois", "reference", "0 4 2 * *", "Civic places", True),
    ("ods_stats", "reference", "0 4 3 * *", "Demographics by district", True),
    ("vergabe_nrw", "reference", "0 7 * * *", "Public tenders", True),
    ("gtfs_static", "reference", "0 4 * * 3", "Transit stops and routes", True),
    ("gtfs_realtime", "event_stream", "*/10 * * * *", "Transit disruptions", True),
    ("lanuv_air", "snapshot", "15 * * * *", "Air quality", True),
    ("autobahn", "event_stream", "*/30 * * * *", "Motorway traffic", True),
    ("strassen", "reference", "0 3 2 * *", "Street register", True),
    ("strassenabschnitte", "reference", "30 3 2 * *", "Street segments", True),
)


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SOURCES), "name string, shape string, cadence_cron string, description string, enabled boolean")
