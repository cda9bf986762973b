"""The engine's functions for SQL texts: expressions, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

# name, arguments, type, expression
FUNCTIONS = (
    ("normalize_text", "s STRING", "STRING", r"trim(regexp_replace(replace(lower(coalesce(s, '')), 'ß', 'ss'), '(?U)\\s+', ' '))"),
    ("strip_tags", "s STRING", "STRING", "nullif(trim(regexp_replace(coalesce(s, ''), '<[^>]+>', '')), '')"),
    (
        "trigrams", "s STRING", "ARRAY<STRING>",
        r"array_distinct(flatten(transform(filter(split(lower(coalesce(s, '')), '[^\\p{L}\\p{N}]+'), w -> w <> ''), w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))",
    ),
    ("trigram_similarity", "a STRING, b STRING", "DOUBLE", "coalesce(size(array_intersect(trigrams(a), trigrams(b))) / nullif(size(array_union(trigrams(a), trigrams(b))), 0), 0D)"),
    (
        "distance_m", "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        "2 * 6371008.8D * asin(least(1D, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
    (
        "within_rings", "lat DOUBLE, lon DOUBLE, rings ARRAY<ARRAY<ARRAY<DOUBLE>>>", "BOOLEAN",
        """coalesce(aggregate(filter(rings, r -> size(r) > 2), 0, (acc, r) -> acc + size(filter(sequence(0, size(r) - 1), i ->
           (get(get(r, i), 1) > lat) <> (get(get(r, (i + 1) % size(r)), 1) > lat) AND lon < get(get(r, i), 0) + (lat - get(get(r, i), 1))
           * (get(get(r, (i + 1) % size(r)), 0) - get(get(r, i), 0)) / nullif(get(get(r, (i + 1) % size(r)), 1) - get(get(r, i), 1), 0)))) % 2 = 1, false)""",
    ),
    ("valid_at", "valid_from TIMESTAMP, valid_to TIMESTAMP, t TIMESTAMP", "BOOLEAN", "IF(t IS NULL, valid_to IS NULL, (valid_from IS NULL OR valid_from <= t) AND (valid_to IS NULL OR valid_to > t))"),
)


def register_functions(spark: SparkSession) -> None:
    """Creates the temporary functions of this session, replacing earlier ones."""
    for name, arguments, kind, expression in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {expression}")
