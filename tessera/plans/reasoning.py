"""Queries on resolution, candidates, insights and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.functions.scalars import candidate_key as key_of
from tessera.functions.temporal import valid_at
from tessera.operators import candidates as cand
from tessera.operators import evaluation, resolution
from tessera.plans import world as w
from tessera.plans.reads import EGO, core

QUERIES: dict = {}
SQL: dict = {}
C = F.col


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def grams_sql(source: str, key: str, label: str) -> str:
    """Distinct trigrams of each label by the rule of two blanks before and one after each word."""
    return f"""SELECT DISTINCT {key}, substr(p, i, 3) AS gram FROM (
  SELECT {key}, '  ' || wd || ' ' AS p, unnest(range(1, length(wd) + 2)) AS i FROM (
    SELECT {key}, unnest(regexp_extract_all(lower({label}), '[\\p{{L}}\\p{{N}}]+')) AS wd FROM {source}))"""


@query("trigram_similarity", f"""WITH pa AS (SELECT DISTINCT p_name AS a FROM part), g AS ({grams_sql('pa', 'a', 'a')}), n AS (SELECT a, count(*) AS n FROM g GROUP BY a),
c AS (SELECT x.a AS a, y.a AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.a < y.a GROUP BY ALL)
SELECT c.a AS a, c.b AS b, round(c / (na.n + nb.n - c)::DOUBLE, 6) AS similarity FROM c JOIN n na ON na.a = c.a JOIN n nb ON nb.a = c.b""")
def trigram_similarity(s: SparkSession, d: str) -> DataFrame:
    """Pairs of part names that share a trigram; the names are a small fixed vocabulary."""
    p = w.load(s, d, "part").select("p_name").distinct()
    g = p.select(C("p_name").alias("a"), text.trigrams(C("p_name")).alias("ga"), F.explode(text.trigrams(C("p_name"))).alias("gram"))
    o = g.select(C("a").alias("b"), C("ga").alias("gb"), "gram")
    pairs = g.join(o, "gram").filter("a < b").select("a", "b", "ga", "gb").distinct()
    return pairs.select("a", "b", F.round(text.set_similarity(C("ga"), C("gb")), 6).alias("similarity"))


SEARCH = "grundschule am wiesenborn"


@query("fuzzy_search", f"""WITH {w.ODS}, one AS (SELECT DISTINCT id, label FROM ods), q AS (SELECT 'q' AS k, '{SEARCH}' AS label), g AS ({grams_sql('one', 'id', 'label')}), gq AS ({grams_sql('q', 'k', 'label')}),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id), c AS (SELECT id, count(*) AS c FROM g JOIN gq USING (gram) GROUP BY id)
SELECT id, label, round(similarity, 6) AS similarity FROM (SELECT id, label, c / (n + (SELECT count(*) FROM gq) - c)::DOUBLE AS similarity FROM c JOIN n USING (id) JOIN one USING (id)) WHERE similarity >= 0.3 ORDER BY similarity DESC, id LIMIT 20""")
def fuzzy_search(s: SparkSession, d: str) -> DataFrame:
    return w.Graph(w.pois(s, d), w.edges(s, d)).search(SEARCH).select("id", "label", F.round("similarity", 6).alias("similarity"))


GEO = f"""pts AS (SELECT id, source, lower(label) AS name, lat, lon FROM osm WHERE lat IS NOT NULL AND lon IS NOT NULL UNION ALL SELECT DISTINCT id, source, lower(label), lat, lon FROM ods WHERE lat IS NOT NULL AND lon IS NOT NULL),
pairs AS (SELECT least(a.id, b.id) AS node_a_id, greatest(a.id, b.id) AS node_b_id, {w.metres('a', 'b')} AS m FROM pts a JOIN pts b ON a.name = b.name AND a.source < b.source WHERE m <= 50)"""


def _geo_pairs(s: SparkSession, d: str) -> DataFrame:
    return resolution.geo_candidates(w.osm(s, d).unionByName(w.pois(s, d)))


@query("er_geo_proximity", f"WITH {w.OSM}, {w.ODS}, {GEO} SELECT node_a_id, node_b_id, round(m, 3) AS dist_m FROM pairs")
def er_geo_proximity(s: SparkSession, d: str) -> DataFrame:
    return _geo_pairs(s, d).select("node_a_id", "node_b_id", F.round("dist_m", 3).alias("dist_m"))


@query("er_geo_confidence", f"WITH {w.OSM}, {w.ODS}, {GEO} SELECT node_a_id, node_b_id, round(greatest(0, 1 - m / 50) * 0.9 + 0.1, 3) AS confidence FROM pairs")
def er_geo_confidence(s: SparkSession, d: str) -> DataFrame:
    return _geo_pairs(s, d).select("node_a_id", "node_b_id", "confidence")


@query("er_triage", f"WITH {w.OSM}, {w.ODS}, {GEO}, c AS (SELECT round(greatest(0, 1 - m / 50) * 0.9 + 0.1, 3) AS x FROM pairs) SELECT CASE WHEN x >= 0.95 THEN 'merge' WHEN x >= 0.70 THEN 'review' ELSE 'drop' END AS decision, count(*) AS n FROM c GROUP BY 1")
def er_triage(s: SparkSession, d: str) -> DataFrame:
    return _geo_pairs(s, d).groupBy(resolution.triage(C("confidence")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@query("er_name_fuzzy", f"""WITH {w.OSM}, {w.ODS}, la AS (SELECT label AS a, count(DISTINCT id) AS n FROM ods GROUP BY 1), lb AS (SELECT label AS b, count(*) AS n FROM osm GROUP BY 1),
ga AS ({grams_sql('la', 'a', 'a')}), gb AS ({grams_sql('lb', 'b', 'b')}), na AS (SELECT a, count(*) AS n FROM ga GROUP BY 1), nb AS (SELECT b, count(*) AS n FROM gb GROUP BY 1),
c AS (SELECT a, b, count(*) AS c FROM ga JOIN gb USING (gram) JOIN na USING (a) JOIN nb USING (b) WHERE na.n >= 0.8 * nb.n AND nb.n >= 0.8 * na.n GROUP BY ALL)
SELECT c.a AS label_a, c.b AS label_b, la.n AS n_a, lb.n AS n_b, round(c / (na.n + nb.n - c)::DOUBLE, 6) AS similarity FROM c JOIN na ON na.a = c.a JOIN nb ON nb.b = c.b JOIN la ON la.a = c.a JOIN lb ON lb.b = c.b WHERE c >= 0.8 * (na.n + nb.n - c) - 1e-9""")
def er_name_fuzzy(s: SparkSession, d: str) -> DataFrame:
    """Classes of equal labels in the two sources, with their sizes; every pair of different labels of similarity 0.8 or more."""
    x = resolution.similar_labels(w.osm(s, d).unionByName(w.pois(s, d)), "POI")
    # opendata_pois sorts before osm_overpass, so the portal's label is the first.
    return x.select("label_a", "label_b", "n_a", "n_b", F.round("similarity", 6).alias("similarity"))


@query("review_queue", f"""WITH {w.OSM}, {w.ODS}, {GEO}, lab AS (SELECT id, label, source FROM osm UNION SELECT id, label, source FROM ods),
t AS (SELECT node_a_id, node_b_id, round(greatest(0, 1 - m / 50) * 0.9 + 0.1, 3) AS confidence FROM pairs WHERE round(greatest(0, 1 - m / 50) * 0.9 + 0.1, 3) >= 0.70 AND round(greatest(0, 1 - m / 50) * 0.9 + 0.1, 3) < 0.95 ORDER BY confidence DESC, node_a_id, node_b_id LIMIT 100)
SELECT node_a_id, node_b_id, confidence, a.label AS a_label, a.source AS a_source, b.label AS b_label, b.source AS b_source FROM t JOIN lab a ON a.id = node_a_id JOIN lab b ON b.id = node_b_id""")
def review_queue(s: SparkSession, d: str) -> DataFrame:
    n = w.osm(s, d).unionByName(w.pois(s, d))
    p = resolution.geo_candidates(n).filter(resolution.triage(C("confidence")) == "review").withColumn("resolved", F.lit(None).cast("boolean"))
    return resolution.review_queue(p, n).select("node_a_id", "node_b_id", "confidence", "a_label", "a_source", "b_label", "b_source")


ANCHORS = """anch AS (SELECT id FROM areas WHERE EXISTS (SELECT 1 FROM edges e WHERE e.to_node_id = areas.id AND e.edge_type = 'LOCATED_IN' AND e.to_s IS NULL)
  AND (EXISTS (SELECT 1 FROM edges e WHERE e.to_node_id = areas.id AND e.edge_type = 'RELATES_TO' AND e.relation = 'mentions_area' AND e.to_s IS NULL)
    OR EXISTS (SELECT 1 FROM edges p JOIN edges m ON m.to_node_id = p.from_node_id AND m.edge_type = 'RELATES_TO' AND m.relation = 'mentions_street' AND m.to_s IS NULL WHERE p.edge_type = 'PART_OF' AND p.to_node_id = areas.id AND p.to_s IS NULL)))"""


def _areas_graph(s: SparkSession, d: str):
    return w.Graph(w.areas(s, d), w.edges(s, d))


@query("area_bridge_anchors", f"WITH {w.AREAS}, {w.EDGES_SQL}, {ANCHORS} SELECT id FROM anch")
def area_bridge_anchors(s: SparkSession, d: str) -> DataFrame:
    return cand.area_bridge_anchors(_areas_graph(s, d), None)


MEMBERS = f"""{ANCHORS}, first_a AS (SELECT id FROM anch ORDER BY id LIMIT 50),
m AS (SELECT to_node_id AS anchor_id, from_node_id AS other_id FROM edges WHERE to_s IS NULL AND (edge_type = 'LOCATED_IN' OR edge_type = 'RELATES_TO' AND relation = 'mentions_area')
  UNION SELECT p.to_node_id, m.from_node_id FROM edges p JOIN edges m ON m.to_node_id = p.from_node_id AND m.edge_type = 'RELATES_TO' AND m.relation = 'mentions_street' AND m.to_s IS NULL WHERE p.edge_type = 'PART_OF' AND p.to_s IS NULL),
mem AS (SELECT anchor_id, other_id FROM m WHERE anchor_id IN (SELECT id FROM first_a) QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY other_id) <= 40)"""


@query("area_bridge_members", f"WITH {w.AREAS}, {w.EDGES_SQL}, {MEMBERS} SELECT anchor_id, other_id FROM mem")
def area_bridge_members(s: SparkSession, d: str) -> DataFrame:
    return cand.area_bridge(_areas_graph(s, d))


@query("diverse_candidates", f"""WITH {w.OSM}, {w.AREAS}, {w.EDGES_SQL}, {MEMBERS}, ids AS (SELECT anchor_id, other_id AS id FROM mem UNION SELECT anchor_id, anchor_id FROM mem),
k AS (SELECT id, node_type FROM osm UNION ALL SELECT id, node_type FROM areas)
SELECT anchor_id, count(DISTINCT node_type) AS n_types, count(DISTINCT id) AS n_nodes FROM ids JOIN k USING (id) GROUP BY 1 HAVING count(DISTINCT node_type) >= 2""")
def diverse_candidates(s: SparkSession, d: str) -> DataFrame:
    g = core(s, d)
    return cand.diverse(cand.collected(cand.area_bridge(g), "area_bridge"), g.nodes).select("anchor_id", "n_types", "n_nodes")


ALL_CANDIDATES = f"""{EGO}, {MEMBERS},
c AS (SELECT 'ego_network' AS generator, 3 AS rank, anchor_id, list_sort(list_distinct(list(other_id) || [anchor_id])) AS ids FROM ego GROUP BY anchor_id
  UNION ALL SELECT 'area_bridge', 2, anchor_id, list_sort(list_distinct(list(other_id) || [anchor_id])) FROM mem GROUP BY anchor_id)"""


def _candidates(s: SparkSession, d: str) -> DataFrame:
    g = core(s, d)
    return cand.collected(cand.ego_network(g), "ego_network").unionByName(cand.collected(cand.area_bridge(g), "area_bridge"))


@query("dedup_candidates", f"WITH {ALL_CANDIDATES} SELECT generator, anchor_id, array_to_string(ids, ',') AS ids FROM c QUALIFY row_number() OVER (PARTITION BY ids ORDER BY rank, anchor_id) = 1")
def dedup_candidates(s: SparkSession, d: str) -> DataFrame:
    x = cand.deduplicated(_candidates(s, d))
    return x.select("generator", "anchor_id", F.array_join(F.array_sort(F.array_distinct("node_ids")), ",").alias("ids"))


@query("candidate_key", f"WITH {ALL_CANDIDATES} SELECT generator, anchor_id, substr(sha256('inefficiency|' || array_to_string(ids, '|')), 1, 32) AS candidate_key FROM c")
def candidate_key(s: SparkSession, d: str) -> DataFrame:
    return _candidates(s, d).select("generator", "anchor_id", key_of(F.lit("inefficiency"), C("node_ids")).alias("candidate_key"))


@query("candidate_payload")
def candidate_payload(s: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of each candidate as JSON, as handed to a model."""
    g = core(s, d)
    return cand.subgraphs(cand.deduplicated(_candidates(s, d)), g).select("generator", "anchor_id", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), "payload")


@query("spatial_temporal_candidates")
def spatial_temporal_candidates(s: SparkSession, d: str) -> DataFrame:
    n = w.traffic(s, d).unionByName(w.osm(s, d))
    return cand.collected(cand.spatial_temporal(w.Graph(n, w.edges(s, d)), radius_m=1500.0), "spatial_temporal").select("generator", "anchor_id", F.array_join("node_ids", ",").alias("node_ids"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    """A model's answer for each motorway message: fenced, bare, noisy or unreadable by turns."""
    b = w.load(s, d, "autobahn").filter("identifier is not null").select("delivery_id", F.coalesce(F.array_join("title", " "), F.lit("")).alias("title"), F.coalesce(F.array_join("description", " "), F.lit("")).alias("description"), (F.pmod("delivery_id", F.lit(100)) / 100.0).alias("confidence"), w.trimmed(C("identifier")).alias("identifier"))
    one = F.to_json(F.struct(F.array(F.struct("title", "description", "confidence")).alias("insights")))
    bare = F.to_json(F.array(F.struct("title", "description", "confidence")))
    k = F.pmod("delivery_id", F.lit(4))
    return b.withColumn("raw", F.when(k == 0, one).when(k == 1, F.concat(F.lit("```json\n"), one, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here you are: "), one, F.lit(" Bye"))).otherwise(bare))


@query("parse_insights", "SELECT delivery_id, coalesce(array_to_string(title, ' '), '') AS title, (delivery_id % 100) / 100.0::DOUBLE AS confidence FROM autobahn WHERE identifier IS NOT NULL")
def parse_insights(s: SparkSession, d: str) -> DataFrame:
    x = _answers(s, d).select("delivery_id", F.explode(text.parse_insights(C("raw"))).alias("i"))
    return x.select("delivery_id", F.get_json_object("i", "$.title").alias("title"), F.get_json_object("i", "$.confidence").cast("double").alias("confidence"))


@query("derive_title", """SELECT delivery_id, substr(coalesce(nullif(subtitle, ''), nullif(split_part(trim(coalesce(array_to_string(description, ' '), '')), '. ', 1), ''), 'Insight'), 1, 200) AS title FROM autobahn""")
def derive_title(s: SparkSession, d: str) -> DataFrame:
    return w.load(s, d, "autobahn").select("delivery_id", text.derive_title(C("subtitle"), F.array_join("description", " ")).alias("title"))


INSIGHTS = f"""i AS (SELECT substr(sha256('t|' || regexp_replace(identifier, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), 1, 32) AS candidate_key, coalesce(array_to_string(title, ' '), '') AS title, (delivery_id % 100) / 100.0::DOUBLE AS confidence FROM autobahn WHERE identifier IS NOT NULL),
fresh AS (SELECT candidate_key, title, confidence FROM i WHERE confidence >= 0.7 QUALIFY row_number() OVER (PARTITION BY candidate_key ORDER BY confidence DESC, title) = 1)"""


def _proposed(s: SparkSession, d: str) -> DataFrame:
    return _answers(s, d).select(F.lit("t").alias("insight_type"), "title", "confidence", F.array("identifier").alias("node_ids"))


@query("insight_dedup", f"WITH {INSIGHTS} SELECT candidate_key, title, confidence FROM fresh WHERE candidate_key NOT IN (SELECT candidate_key FROM i WHERE confidence = 0.99)")
def insight_dedup(s: SparkSession, d: str) -> DataFrame:
    p = _proposed(s, d)
    stored = p.filter("confidence = 0.99").select(key_of(C("insight_type"), C("node_ids")).alias("candidate_key"))
    return cand.new_insights(p, stored).select("candidate_key", "title", "confidence")


@query("stored_insights", f"WITH {INSIGHTS} SELECT candidate_key, title, confidence FROM fresh WHERE confidence >= 0.8 ORDER BY confidence DESC, candidate_key LIMIT 100")
def stored_insights(s: SparkSession, d: str) -> DataFrame:
    none = _proposed(s, d).limit(0).select(F.lit("").alias("candidate_key"))
    i = cand.new_insights(_proposed(s, d), none).withColumns({"status": F.lit("new"), "created_at": F.lit("2026-01-01").cast("timestamp")})
    return cand.stored_insights(i, 0.8, "new").select("candidate_key", "title", "confidence")


PRF = """g AS (SELECT DISTINCT edge_type AS ex, from_node_id AS item FROM edge_feed WHERE NOT inferred), p AS (SELECT DISTINCT edge_type AS ex, from_node_id AS item FROM edge_feed WHERE confidence >= 0.7),
c AS (SELECT coalesce(g.ex, p.ex) AS ex, count(*) FILTER (g.item IS NOT NULL AND p.item IS NOT NULL) AS tp, count(*) FILTER (g.item IS NULL) AS fp, count(*) FILTER (p.item IS NULL) AS fn FROM g FULL JOIN p ON g.ex = p.ex AND g.item = p.item GROUP BY 1)"""
SCORES = """round(pr, 4) AS precision, round(re, 4) AS recall, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 4) AS f1"""
RATES = "CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp)::DOUBLE END AS pr, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn)::DOUBLE END AS re"


def _counts(s: SparkSession, d: str) -> DataFrame:
    e = w.load(s, d, "edge_feed").select(C("edge_type").alias("example"), C("from_node_id").alias("item"), "inferred", "confidence")
    return evaluation.counts(e.filter("not inferred"), e.filter("confidence >= 0.7"), ["example"], ["item"])


@query("prf_score", f"WITH {PRF}, x AS (SELECT ex, tp, fp, fn, {RATES} FROM c) SELECT ex AS example, tp, fp, fn, {SCORES} FROM x")
def prf_score(s: SparkSession, d: str) -> DataFrame:
    return evaluation.scores(_counts(s, d))


@query("prf_micro", f"WITH {PRF}, t AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c), x AS (SELECT tp, fp, fn, {RATES} FROM t) SELECT tp, fp, fn, {SCORES} FROM x")
def prf_micro(s: SparkSession, d: str) -> DataFrame:
    return evaluation.micro(_counts(s, d))
