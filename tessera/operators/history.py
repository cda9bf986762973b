"""Full history of changing entity attributes.

``build`` turns observations into versions. ``HistoryStore`` keeps the raw changes and the versions
in the shared folder; a batch of late or corrected observations rebuilds only the chains of the
entities it touches, from their raw changes, and replaces those chains in one atomic commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessera.storage import filesystem, load, materialise, scratch

HOT_ROWS = 200_000  # more observations than this make an entity hot: it is cut into parts of about as many
CELLS = 65_536  # steps of a hot entity's time in which its observations are counted
BUCKETS = 32  # parts of a store by the hash of the key


def canonical_json(c: Column) -> Column:
    """Equal for texts of equal JSON content: keys sorted, white space and escapes gone; other texts stay as they are."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)


def effective(obs: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """One row per entity and effect time: the observation with the latest ``observed_at``.

    Input columns besides keys and attributes: ``effect``, ``observed_at``, ``valid_to``. Of equally
    late observations the greatest row counts, so the result doesn't depend on the order of input.
    """
    payload = F.struct("observed_at", *attrs, "valid_to")
    return obs.groupBy(*keys, "effect").agg(F.max(payload).alias("p")).select(*keys, "effect", *[F.col(f"p.{a}").alias(a) for a in attrs], F.col("p.valid_to").alias("vt"))


def _pairs(x: DataFrame, w: Window, nxt: Column) -> DataFrame:
    """Rows with ``new`` set, each with ``vt`` and ``nxt`` of the last row of its run."""
    x = x.withColumns({"is_last": F.coalesce(F.lead("new").over(w), F.lit(True)), "nxt": nxt}).filter("new or is_last")
    take = lambda c: F.when(F.col("is_last"), F.col(c)).otherwise(F.lead(c).over(w))
    return x.withColumns({"run_vt": take("vt"), "run_nxt": take("nxt")}).filter("new").drop("vt", "nxt", "is_last").withColumnsRenamed({"run_vt": "vt", "run_nxt": "nxt"})


def build(obs: DataFrame, keys: list[str], attrs: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Versions of every entity: keys, attributes, ``start``, ``end`` (null while open).

    An observation's ``effect`` orders it; neighbours with equal attributes are one version, unless
    the earlier one's ``valid_to`` lies at or before the later one's effect. A version ends at the
    next start or at its last observation's ``valid_to``, whichever comes first. Null attributes are
    values like others. Rows whose ``effect`` or whose last key is null must be filtered before.

    Ordinary entities take one window over the entity. Hot ones (more than ``hot_rows`` observations, however
    many there are in all) are cut into parts of about ``hot_rows`` by their effect times; each part is
    folded by itself and only its first and last runs meet in a second, small window.
    """
    # Within, keys and attributes have names of their own: theirs may be any.
    as_key, as_attr = {k: f"__k{i}" for i, k in enumerate(keys)}, {a: f"__a{i}" for i, a in enumerate(attrs)}
    obs = obs.select(*[F.col(f"`{k}`").alias(v) for k, v in {**as_key, **as_attr}.items()], *[F.col(c) for c in ("effect", "observed_at", "valid_to")])
    chains = _build(obs, list(as_key.values()), list(as_attr.values()), hot_rows)
    return chains.withColumnsRenamed({v: k for k, v in {**as_key, **as_attr}.items()})


def _build(obs: DataFrame, keys: list[str], attrs: list[str], hot_rows: int) -> DataFrame:
    seen = effective(obs, keys, attrs)
    us = F.unix_micros("effect")
    counts = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(us).alias("lo"), F.max(us).alias("hi"))
    segmented = (counts.agg(F.max("n")).first()[0] or 0) > hot_rows
    if segmented:
        seen = _in_parts(seen, materialise(counts.filter(F.col("n") > hot_rows), "hot"), keys, hot_rows)
    else:
        seen = seen.withColumns({"seg": F.lit(0), "hot": F.lit(False)})
    same = lambda w: F.reduce(F.array(*[F.col(a).eqNullSafe(F.lag(a).over(w)) for a in attrs]), F.lit(True), lambda a, b: a & b)
    by = [*keys, "seg"] if segmented else keys
    w = Window.partitionBy(*by).orderBy("effect")
    first = F.row_number().over(w) == 1
    ended = F.coalesce(F.lag("vt").over(w) <= F.col("effect"), F.lit(False))
    x = seen.withColumn("seg_first", first).withColumn("new", F.col("seg_first") | ~same(w) | ended)
    runs = _pairs(x, w, F.lead("effect").over(w))
    if segmented:
        runs = runs.withColumn("seg_last", F.col("nxt").isNull())
        edge = F.col("hot") & (F.col("seg_first") | F.col("seg_last"))
        w2 = Window.partitionBy(*keys).orderBy("effect")
        ended2 = F.coalesce(F.lag("vt").over(w2) <= F.col("effect"), F.lit(False))
        y = runs.filter(edge).withColumn("new", ~F.col("seg_first") | (F.row_number().over(w2) == 1) | ~same(w2) | ended2)
        y = _pairs(y.withColumnRenamed("nxt", "own_nxt"), w2, F.when(F.col("seg_last"), F.lead("effect").over(w2)).otherwise(F.col("own_nxt"))).drop("own_nxt")
        rest = runs.filter(~edge)
        runs = rest.unionByName(y.select(*rest.columns))
    return runs.select(*keys, *attrs, F.col("effect").alias("start"), F.least("nxt", "vt").alias("end"))


def _in_parts(seen: DataFrame, hot: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """Adds ``hot`` and ``seg``, the part of its entity a row is in: parts have about ``hot_rows`` rows, so there are as many as an entity needs.

    A hot entity's rows are counted by steps of its time; the running count over at most ``CELLS`` steps gives the parts.
    """
    x = seen.join(hot, keys, "left").withColumn("hot", F.col("n").isNotNull())
    step = F.floor((F.unix_micros("effect") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / CELLS + 1)).cast("int")
    x = x.withColumn("cell", step).drop("n", "lo", "hi")
    n = x.filter("hot").groupBy(*keys, "cell").count()
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("cell")) - F.col("count")
    parts = materialise(n.select(*keys, "cell", F.floor(before / hot_rows).cast("int").alias("part")), "parts")
    return x.join(parts, [*keys, "cell"], "left").withColumn("seg", F.coalesce("part", F.lit(0))).drop("cell", "part")


class HistoryStore:
    """Raw changes and version chains of one relation below a folder, in buckets by the hash of the key.

    Each batch adds its raw changes as a generation of its own. The chains of the buckets it touches are written
    anew: those of touched entities rebuilt from their raw changes, the others as they were; other buckets aren't
    read. The newest manifest names the generations of raw changes and, for each bucket, the one its chains are in. It
    is written under another name and renamed without overwriting, so a batch is seen whole or not at all, and a lost
    driver leaves only unnamed files.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], attrs: list[str], hot_rows: int = HOT_ROWS, buckets: int = BUCKETS):
        """``buckets`` counts when the store is made; later the stored number holds."""
        self.spark, self.path, self.keys, self.attrs, self.hot_rows, self.buckets = spark, path, keys, attrs, hot_rows, buckets

    def _commits(self) -> list[str]:
        fs, folder = filesystem(self.spark, f"{self.path}/_manifests")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")) if fs.exists(folder) else []

    def _manifest(self) -> dict:
        names = self._commits()
        if not names:
            return {"buckets": self.buckets, "raw": {}, "chains": {}}
        return json.loads(self.spark.read.text(f"{self.path}/_manifests/{names[-1]}", wholetext=True).first()[0])

    def _commit(self, manifest: dict, after: int) -> None:
        """The manifest after the first ``after`` ones; another writer's in its place is an error."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        name = f"{self.path}/_manifests/{after + 1:08d}"
        fs, tmp = filesystem(self.spark, f"{name}.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        # This rename, unlike the file system's own, refuses to replace what is there.
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri(), conf).rename(tmp, jvm.org.apache.hadoop.fs.Path(f"{name}.json"), options)
        except Exception as error:
            raise RuntimeError("another writer committed this generation") from error

    def _paths(self, of: dict[str, list[str]] | dict[str, str], kind: str, buckets: list[str] | None = None) -> list[str]:
        every = sorted(of) if buckets is None else [b for b in buckets if b in of]
        return [f"{self.path}/{g}/{kind}/__bucket={b}" for b in every for g in ([of[b]] if isinstance(of[b], str) else of[b])]

    def _read(self, paths: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _schema(self, manifest: dict, kind: str):
        return StructType.fromJson(manifest["schema"][kind])

    def raw(self, buckets: list[str] | None = None) -> DataFrame | None:
        """Raw changes, of some buckets or all."""
        m = self._manifest()
        return self._read(self._paths(m["raw"], "raw", buckets), self._schema(m, "raw")) if m["raw"] else None

    def current(self, manifest: dict | None = None, buckets: list[str] | None = None) -> DataFrame | None:
        """Every version, of some buckets or all: each bucket's chains lie in one place, so reading them takes no join."""
        m = self._manifest() if manifest is None else manifest
        return self._read(self._paths(m["chains"], "chains", buckets), self._schema(m, "chains")) if m["chains"] else None

    def apply(self, batch: DataFrame) -> None:
        """Adds a batch of observations (keys, attrs, effect, observed_at, valid_to) and replaces the touched chains."""
        commits, m = len(self._commits()), self._manifest()
        gen = scratch(self.spark, "gen").rsplit("/", 1)[1]
        base = f"{self.path}/{gen}"
        # Rebalanced by bucket, a write makes few files; adaptive execution splits large buckets among tasks.
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(m["buckets"])).alias("__bucket")
        raw = batch.select(*[F.col(f"`{c}`") for c in (*self.keys, "effect", "observed_at", *self.attrs, "valid_to")])
        raw.select("*", bucket).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{base}/raw")
        written = self.spark.read.schema(StructType([*raw.schema.fields, StructField("__bucket", LongType())])).parquet(f"{base}/raw")
        fresh = written.drop("__bucket")
        touched = sorted(str(r[0]) for r in written.select("__bucket").distinct().collect())  # at most as many as there are buckets
        mine = materialise(fresh.select(*self.keys).distinct(), "touched") if m["raw"] else None
        changes = fresh if mine is None else self.raw(touched).join(mine, self.keys, "left_semi").unionByName(fresh)
        chains = build(changes, self.keys, self.attrs, self.hot_rows)
        kept = self.current(m, touched) if m["chains"] else None
        whole = chains if kept is None else chains.unionByName(kept.join(mine, self.keys, "left_anti"))
        whole.select("*", bucket).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{base}/chains")
        self._commit({
            "buckets": m["buckets"], "schema": {"raw": json.loads(raw.schema.json()), "chains": json.loads(chains.schema.json())},
            "raw": {b: [*m["raw"].get(b, []), *([gen] if b in touched else [])] for b in {*m["raw"], *touched}}, "chains": m["chains"] | {b: gen for b in touched},
        }, commits)

    def compact(self) -> None:
        """The raw changes of all generations in one. Older files stay for readers that are at them."""
        commits, m = len(self._commits()), self._manifest()
        if all(len(g) < 2 for g in m["raw"].values()):
            return
        gen = scratch(self.spark, "gen").rsplit("/", 1)[1]
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(m["buckets"])).alias("__bucket")
        self.raw().select("*", bucket).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{gen}/raw")
        self._commit(m | {"raw": {b: [gen] for b in m["raw"]}}, commits)


KEYS = ["source", "source_id"]
ATTRS = ["edge_type", "from_node_id", "to_node_id", "properties"]


def edge_observations(edges: DataFrame) -> DataFrame:
    """Observations of ``edge_feed``: rows without source_id, or without any time, state no version."""
    return edges.filter("source_id is not null").select(
        F.coalesce("source", F.lit("")).alias("source"), "source_id", F.coalesce("valid_from", "observed_at").alias("effect"), "observed_at",
        "edge_type", "from_node_id", "to_node_id", canonical_json(F.col("properties")).alias("properties"), "valid_to", "received_at",
    ).filter("effect is not null")


def edge_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of ``edge_feed``: the first nine tenths by time of receipt are loaded, the later ones rebuild their chains."""
    obs = edge_observations(load(spark, sf_dir, "edge_feed"))
    cut = obs.agg(F.percentile_approx(F.unix_micros("received_at"), 0.9, 10_000)).first()[0]
    late = F.coalesce(F.unix_micros("received_at") > F.lit(cut), F.lit(True)) if cut is not None else F.lit(False)
    store = HistoryStore(spark, scratch(spark, "history"), KEYS, ATTRS)
    store.apply(obs.filter(~late))
    store.apply(obs.filter(late))
    return store.current()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_history(spark, sf_dir).select("source", "source_id", F.unix_seconds("start").alias("start_s"), F.coalesce(F.unix_seconds("end"), F.lit(-1)).cast("long").alias("end_s"))


FOUND_SQL = """
WITH o AS (
  SELECT coalesce(source, '') AS source, source_id, coalesce(valid_from, observed_at) AS effect, observed_at, valid_to, edge_type, from_node_id, to_node_id,
         list_sort(list_transform(json_keys(properties), lambda k: k || '=' || (properties::JSON -> ('$."' || k || '"'))::VARCHAR)) AS props
  FROM edge_feed WHERE source_id IS NOT NULL AND coalesce(valid_from, observed_at) IS NOT NULL
), l AS (SELECT *, row_number() OVER (PARTITION BY source, source_id, effect ORDER BY observed_at DESC) AS rn FROM o),
e AS (SELECT * FROM l WHERE rn = 1),
n AS (
  SELECT *, CASE WHEN lag(effect) OVER w IS NULL THEN 1
                 WHEN (edge_type, from_node_id, to_node_id) IS DISTINCT FROM (lag(edge_type) OVER w, lag(from_node_id) OVER w, lag(to_node_id) OVER w) THEN 1
                 WHEN props::VARCHAR IS DISTINCT FROM (lag(props) OVER w)::VARCHAR THEN 1
                 WHEN lag(valid_to) OVER w <= effect THEN 1 ELSE 0 END AS is_new
  FROM e WINDOW w AS (PARTITION BY source, source_id ORDER BY effect)
), g AS (SELECT *, sum(is_new) OVER (PARTITION BY source, source_id ORDER BY effect) AS gid FROM n),
v AS (SELECT source, source_id, gid, min(effect) AS s, arg_max(coalesce(valid_to, TIMESTAMPTZ '9999-01-01'), effect) AS vt FROM g GROUP BY ALL),
x AS (SELECT *, lead(s) OVER (PARTITION BY source, source_id ORDER BY s) AS nx FROM v)
SELECT source, source_id, epoch_us(s) // 1000000 AS start_s,
       CASE WHEN least(coalesce(nx, TIMESTAMPTZ '9999-01-01'), vt) >= TIMESTAMPTZ '9999-01-01' THEN -1 ELSE epoch_us(least(coalesce(nx, TIMESTAMPTZ '9999-01-01'), vt)) // 1000000 END AS end_s
FROM x
"""
