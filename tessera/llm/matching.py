"""The same places in two sources without a common key.

Records are brought to comparable attributes (words of the name, street, house number, position).
What the words and categories mean is learnt from the tables (``naming``): words that so many share
that they tell no places apart, words that say a kind, and which kinds of one table go with which of the
other, by how often they meet in pairs of equal name at one spot.

Every record enters the blocks. Candidates share a MinHash value of name or street within a grid cell, or
the name with a MinHash value of the street anywhere, so that a wrong position loses no pair; where either
side has no usable position, also the street's values with the house number, and where a street is missing
too, two values of the name with a kind that fits. Candidate pairs get similarity features, a logistic model
fitted on weakly labelled pairs weighs them, and Platt scaling on other weakly labelled pairs turns the
score into a probability.

Records travel once, to the part of the map they lie in, and are blocked and compared there (``comparing``). Only the
pairs of the other blocks are looked for by key first; each goes to its element, with the place's attributes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.comparing import FEATURES, LIKENESS, MAP, PAIRS_AT_ONCE, PORTAL, TELLS, blocks, equal_pairs, features, keyed, likeness
from tessera.llm.naming import STREET_BANDS, Learnt, attributes, learn, minhash
from tessera.storage import drop, load, materialise

TRAIN_ROWS = 20_000  # weakly labelled pairs the model is fitted on, at most (about)
CELL_LAT, CELL_LON = 0.01, 0.016  # about 1.1 km
REACH_LAT = 0.0027  # about 300 m: a neighbouring cell nearer than this is searched too
LON_CELLS = 22_500  # cells around the globe
SEED_M = 250.0  # records of equal name this near teach which kinds go together
PART_ROWS = 10_000  # records of a part of the map, about
MATCH = 0.5


def fold(c: Column) -> Column:
    """Lower case, umlauts spelt out, everything else but letters and digits as single blanks."""
    x = low = F.lower(F.coalesce(c, F.lit("")))
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        x = F.replace(x, F.lit(a), F.lit(b))
    # Texts of plain letters have nothing to spell out, and a plainer class of letters is faster.
    plain = F.octet_length(low) == F.char_length(low)
    return F.trim(F.when(plain, F.regexp_replace(low, "[^a-z0-9]+", " ")).otherwise(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " ")))


def _number(c: Column) -> Column:
    return F.nullif(F.replace(fold(c), F.lit(" "), F.lit("")), F.lit(""))


def _finite(c: Column, most: float) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) <= most), c)


def _record(x: DataFrame) -> DataFrame:
    """House numbers that stand in the street go to their own column; the street without blanks."""
    st, ends = F.col("st"), F.col("ends")
    street = F.replace(F.when(ends == "", st).otherwise(F.left(st, F.length(st) - F.length(ends))), F.lit(" "), F.lit(""))
    inside = F.nullif(F.replace(ends, F.lit(" "), F.lit("")), F.lit(""))
    both = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return x.withColumn("ends", F.regexp_extract("st", r"\s\d+\s?[a-z]?$", 0)).select("id", "at", "name", "cats", street.alias("street"), F.coalesce(_number(F.col("no")), inside).alias("number"), F.when(both, F.col("lat")).alias("lat"), F.when(both, F.col("lon")).alias("lon"))


def portal_records(ods: DataFrame) -> DataFrame:
    """Rows of the portal in common columns, repeated rows included; rows without source_id take no part."""
    art = fold(F.col("objektart"))
    lat, lon = F.col("geo_point_2d.lat"), F.col("geo_point_2d.lon")
    return _record(ods.filter("source_id is not null").select(
        F.col("source_id").alias("id"), F.lit(0).cast("long").alias("at"), fold(F.col("objektname")).alias("name"), F.when(art == "", F.array().cast("array<string>")).otherwise(F.array(art)).alias("cats"),
        fold(F.col("strasse")).alias("st"), F.col("hausnummer").alias("no"), _finite(lat, 180).alias("lat"), _finite(lon, 180).alias("lon"),
    ))


def map_records(osm: DataFrame) -> DataFrame:
    """Rows of the map in common columns, repeated rows included; a label made of the id is no name."""
    name = F.coalesce(F.try_element_at("tags", F.lit("name")), F.when(~F.col("label").rlike(r"^OSM (node|way|relation) \d+$"), F.col("label")))
    # Map elements may state several categories.
    said = F.transform(F.map_entries(F.map_filter("tags", lambda k, v: k != "name")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return _record(osm.filter("source_id is not null").select(
        F.col("source_id").alias("id"), F.coalesce(F.unix_micros("fetched_at"), F.lit(-(2**62))).alias("at"), fold(name).alias("name"), F.coalesce(said, F.array().cast("array<string>")).alias("cats"),
        fold(F.col("addr_street")).alias("st"), F.col("addr_housenumber").alias("no"), F.coalesce(_finite(F.col("lat"), 180), _finite(F.col("center.lat"), 180)).alias("lat"), F.coalesce(_finite(F.col("lon"), 180), _finite(F.col("center.lon"), 180)).alias("lon"),
    ))


def region(rows: DataFrame) -> tuple[float, float, float, float] | None:
    """Latitudes and longitudes between which the places lie: the middle 98 % and half as much again on either side."""
    q = rows.agg(F.percentile_approx("lat", [0.01, 0.99], 10_000), F.percentile_approx("lon", [0.01, 0.99], 10_000)).first()
    if q[0] is None or q[1] is None:
        return None
    wide = lambda lo, hi, least: (lo - max((hi - lo) / 2, least), hi + max((hi - lo) / 2, least))
    return (*wide(*q[0], 0.1), *wide(*q[1], 0.1))


def placed(x: DataFrame, box: tuple[float, float, float, float] | None) -> DataFrame:
    """Exchanged coordinates put right; a position far from where the places of both tables lie says nothing."""
    if box is None:
        return x
    lat, lon = F.col("lat"), F.col("lon")
    fits = lambda a, b: a.between(box[0], box[1]) & b.between(box[2], box[3])
    pick = lambda a, b: F.when(fits(lat, lon), a).when(fits(lon, lat), b)
    return x.withColumns({"lat": pick(lat, lon), "lon": pick(lon, lat)})


def own_names(x: DataFrame) -> DataFrame:
    """Adds ``own``: a name that is but the street's, with or without a number, says nothing about the place."""
    joined = F.replace(F.regexp_replace("core", r" \d+ ?[a-z]?$", ""), F.lit(" "), F.lit(""))
    # The names that differ in length by more than that needn't be compared.
    most = F.length("street") / 6
    alike = (F.abs(F.length("joined") - F.length("street")) <= most) & (F.levenshtein("joined", F.col("street")) <= most)
    return x.withColumn("joined", joined).withColumn("own", (F.col("rare") != "") & ~((F.col("street") != "") & alike)).drop("joined")


def _cells(lat: Column, lon: Column, reach: bool) -> Column:
    """Cells of a position; with ``reach`` also the neighbours within reach of it."""
    wide = F.lit(REACH_LAT) / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))
    steps = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1), (-1, -1), (-1, 1), (1, -1), (1, 1)) if reach else ((0, 0),)
    cell = lambda dy, dx: F.floor((lat + dy * REACH_LAT) / CELL_LAT).cast("long") * 100_000 + F.pmod(F.floor((lon + wide * dx) / CELL_LON).cast("long"), F.lit(LON_CELLS))
    return F.array_distinct(F.array(*[cell(dy, dx) for dy, dx in steps]))


class Kinds:
    """Which kinds of the portal go with which of the map, by the log of how much more often than by chance they meet."""

    def __init__(self, seen: list[tuple[int, int, int]], ones: tuple[dict[int, int], dict[int, int]], total: int, known: Learnt):
        self.dull, self.records = known.dull, sum(known.records)
        self._rows: list[list[float]] | None = None
        self._known: tuple[dict, dict] = {}, {}
        sizes = [1 + max(f.values(), default=0) for f in known.features]
        self.lift = np.zeros(sizes, np.float32)
        n = np.zeros(sizes)
        for a, b, k in seen:
            n[a, b] = k
        na, nb = (np.array([ones[s].get(i, 0) for i in range(sizes[s])], dtype=float) for s in (0, 1))
        if total:
            self.lift = np.log((n + 1) / (np.outer(na, nb) / total + 1)).astype(np.float32)
        # A feature says something if knowing it changes what the other side's features are (divergence from chance, in nats).
        self.tells = [(n * self.lift).sum(axis=axis) / np.maximum(n.sum(axis=axis), 1) >= TELLS / 2 for axis in (1, 0)]
        # A kind of the map that hardly any place of the portal's is seen to be, though many records have it, fits none.
        for f, i in known.features[MAP].items():
            due = known.counts[MAP][f] * total / max(known.records[MAP], 1)
            if (gap := np.log((nb[i] + 1) / (due + 1))) < -3 * TELLS:
                self.lift[:, i] = gap
                self.tells[MAP][i] = True
        self.words = [{i for f, i in known.features[s].items() if f.startswith("w:")} for s in (0, 1)]
        category = {i for f, i in known.features[MAP].items() if f.startswith("c:")}
        # The map's categories that a kind of the portal goes with.
        goes = (self.lift >= TELLS) & (n >= 0.2 * na[:, None])
        self.goes = {a: [b for b in np.flatnonzero(goes[a]) if b in category] for a in range(sizes[0])}
        self.classes_of_map = {b for bs in self.goes.values() for b in bs}

    def parts(self, sig: str, side: int) -> list[int]:
        return [i for i in map(int, sig.split(",")) if self.tells[side][i]] if sig else []

    def fit(self, o: str, m: str) -> tuple[float | None, float | None]:
        """The best agreement of any two kinds, and the best that the least fitting kind has; None where either says nothing."""
        if self._rows is None:  # plain numbers are faster for as few as a pair has
            self._rows = self.lift.tolist()
        (a, a_words), (b, b_words) = self._said(o, PORTAL), self._said(m, MAP)
        if not a or not b:
            return None, None
        high, low = self._ends(a, b)
        # Words are more exact than categories: where both names have some, these must fit each other.
        if a_words and b_words:
            low = min(low, self._ends(a_words, b_words)[1])
        return high, min(low, 0.0)

    def _said(self, sig: str, side: int) -> tuple[list[int], list[int]]:
        """The kinds of a signature that say something, and those of them that are words."""
        if (out := self._known[side].get(sig)) is None:
            said = self.parts(sig, side)
            out = self._known[side][sig] = said, [i for i in said if i in self.words[side]]
        return out

    def _ends(self, a: list[int], b: list[int]) -> tuple[float, float]:
        """The best agreement of any two, and the best of the one that fits least."""
        x = [[row[j] for j in b] for row in (self._rows[i] for i in a)]
        best = [max(r) for r in x]
        return max(best), min(*best, *map(max, zip(*x, strict=True)))

    def classes(self, sig: str, side: int) -> list[str]:
        """Marks of which two records share one if their kinds fit: ``?`` is a kind that isn't known, ``-`` one that none of the portal's goes with."""
        if side == MAP:
            said = self.parts(sig, MAP)
            return [str(i) for i in said if i in self.classes_of_map] or (["-"] if said else ["?"])
        own = sorted({str(b) for a in self.parts(sig, PORTAL) for b in self.goes[a]})
        return [*own, "?"] if own else [*map(str, sorted(self.classes_of_map)), "?", "-"]


def learn_kinds(portal: DataFrame, places: DataFrame, known: Learnt) -> Kinds:
    """From all pairs with the same rare words and house number at one spot: a join on these and the cell, counted by signature.

    The number keeps out neighbours that bear the same name, which would make their kinds look alike.
    """
    spot = lambda x, p: x.filter("lat is not null and own and number is not null").select(F.xxhash64("rare", "number", _cells(F.col("lat"), F.col("lon"), False)[0]).alias("k"), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"), F.col("sig").alias(f"{p}sig"))
    near = spot(portal, "o").join(spot(places, "m"), "k").filter(_metres(F.col("olat"), F.col("olon"), F.col("mlat"), F.col("mlon")) < SEED_M)
    both = materialise(near.groupBy("osig", "msig").count(), "kinds")  # read four times
    parts = lambda c: F.filter(F.split(c, ","), lambda v: v != "")
    seen = both.select("count", parts(F.col("osig")).alias("a"), parts(F.col("msig")).alias("b"))
    # A row for each pair of features that meet, and one for each feature: as bounded as the features.
    a = seen.select(F.explode("a").alias("a"), F.lit("").alias("b"), "count")
    b = seen.select(F.lit("").alias("a"), F.explode("b").alias("b"), "count")
    ab = seen.select(F.explode("a").alias("a"), "b", "count").select("a", F.explode("b").alias("b"), "count")
    rows = ab.unionByName(a).unionByName(b).unionByName(seen.select(F.lit("").alias("a"), F.lit("").alias("b"), "count")).groupBy("a", "b").agg(F.sum("count").alias("n")).collect()
    ones = ({int(r["a"]): r["n"] for r in rows if r["a"] and not r["b"]}, {int(r["b"]): r["n"] for r in rows if r["b"] and not r["a"]})
    total = next((r["n"] for r in rows if not r["a"] and not r["b"]), 0)
    return Kinds([(int(r["a"]), int(r["b"]), r["n"]) for r in rows if r["a"] and r["b"]], ones, total, known)


def _metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dx = F.abs(lon1 - lon2)
    return 111_195.0 * F.sqrt(F.pow(lat1 - lat2, 2) + F.pow(F.least(dx, 360 - dx) * F.cos(F.radians(lat1)), 2))


VERSION = ("id", "core", "rare", "own", "sig", "street", "number", "lat", "lon")
TEXTS = ("core", "rare", "sig", "street", "number", "id")  # in one text, since short ones cost more room apart; only ids may hold the separator
SEPARATOR = "\x1f"
KEYS = "key long, v long, cell long, lat double, lon double"
# What a row in a part of the map is: a place of the portal there, an element, a place with the element it may be (ANEW: one whose
# record has several versions), or a version of such a record with the attributes that its latest one has.
NEAR, ELEMENT, AIMED, ANEW, VERSIONS = range(5)


def _far_keys(x: DataFrame, kinds: Kinds, side: int) -> DataFrame:
    """``KEYS``: the blocks of a record (v: its version) that don't lie in a cell.

    1: name and street, which also finds records whose position is wrong. 100: portal records without position against all
    elements; 200: elements without position against portal records with one. Where a street is missing too, names alone,
    of kinds that fit. 300: portal records without position against elements without street; 400: portal records without
    either against elements with a street; 500: portal records with position against elements without either; 600: portal
    records with position but no street against elements with a street but no position.
    """
    portal, dull = side == PORTAL, kinds.dull

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}

        def hashed(texts: pa.Array) -> np.ndarray:
            d = texts.dictionary_encode()
            return pd.util.hash_array(np.asarray(d.dictionary.to_pylist(), dtype=object), categorize=False)[d.indices.to_numpy(zero_copy_only=False)]

        for b in batches:
            column = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            rare, street, numbers = column("rare"), column("street"), column("number")
            said, number = hashed(rare), hashed(numbers.fill_null(""))
            n0, n1 = (v.fill_null(0).to_numpy(zero_copy_only=False) for v in minhash(rare, 2))
            s = [v.fill_null(0).to_numpy(zero_copy_only=False) for v in minhash(street, STREET_BANDS, dull)]
            named, bare = (f(c, "").to_numpy(zero_copy_only=False) for f, c in ((pc.not_equal, rare), (pc.equal, street)))
            lost = np.isnan(column("lat").to_numpy(zero_copy_only=False))
            housed = ~bare & ~np.asarray(numbers.is_null())
            keys, rows = [], []

            def add(tag: int, who: np.ndarray, *values: np.ndarray) -> None:
                at = np.flatnonzero(who)
                keys.append(keyed(tag, *[v[at] for v in values]))  # noqa: B023
                rows.append(at)  # noqa: B023

            add(1, named & ~bare, said, s[0])
            add(100, housed & lost if portal else housed, *s, number)
            add(200, housed & ~lost if portal else housed & lost, *s, number)
            sigs = column("sig").dictionary_encode()
            sigs, sig = sigs.dictionary.to_pylist(), sigs.indices.to_numpy(zero_copy_only=False)
            for tag, o, m in ((300, lost, bare), (400, lost & bare, ~bare), (500, ~lost, lost & bare), (600, ~lost & bare, lost & ~bare)):
                at = np.flatnonzero(named & (o if portal else m))
                which, back = np.unique(sig[at], return_inverse=True)
                for t in (sigs[i] for i in which):
                    if t not in known:
                        known[t] = np.array([-1 if c == "?" else -2 if c == "-" else int(c) for c in kinds.classes(t, side)], dtype=np.int64)
                # The classes of each row: those of its signature, which stand one after the other.
                each = [known[sigs[i]] for i in which]
                n = np.array([len(c) for c in each], dtype=np.int64)
                first, n = (np.cumsum(n) - n)[back], n[back]
                row = np.repeat(at, n)
                place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                keys.append(keyed(tag, n0[row], n1[row], np.concatenate([*each, np.empty(0, np.int64)])[place]))
                rows.append(row)
            at = pa.array(np.concatenate(rows))
            # A position is asked for by the first block alone.
            first = pa.array(np.arange(len(at)) >= len(rows[0]))
            here = lambda c: pc.if_else(first, pa.scalar(None, pa.float64()), column(c).take(at))  # noqa: E731, B023
            cols = [pa.array(np.concatenate(keys).view(np.int64)), column("v").take(at), column("cell").take(at), here("lat"), here("lon")]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in KEYS.split(", ")])

    return x.select("v", "cell", "rare", "sig", "street", "number", F.coalesce("lat", F.lit(float("nan"))).alias("lat"), F.coalesce("lon", F.lit(float("nan"))).alias("lon")).mapInArrow(of, KEYS)


def _versions(x: DataFrame, name: str, *columns: str) -> DataFrame:
    """``v, last`` of the records that have several versions: the latest one, of equally late ones that with the least hash."""
    # An aggregate finds them without sorting all records; where there are none, nothing else is read.
    several = materialise(x.groupBy("h").agg(F.min("v").alias("a"), F.max("v").alias("b")).filter("a != b").select("h"), f"{name}-of")
    if several.isEmpty():
        return x.select("v", F.col("v").alias("last"), *columns).limit(0)
    w = Window.partitionBy("h").orderBy(F.desc("at"), "v")
    x = x.select("h", "at", "v", *columns).join(several, "h").withColumn("last", F.first("v").over(w))
    return materialise(x.select("v", "last", *columns).distinct(), name)


def _compared(portal: DataFrame, places: DataFrame, kinds: Kinds) -> DataFrame:
    """``o_id, m_id``, the likeness of their attributes and a weak ``label`` of each pair that shares a block.

    Each row goes to the part of the map its cell is in, those without position to any. Of repeated records every row enters
    the blocks and the latest is compared: its attributes are sent after the others; their pairs (``anew``) may come out repeatedly.
    """
    usable = F.col("lat").isNotNull()
    portal, places = (x.withColumns({"v": F.xxhash64(*VERSION), "cell": F.when(usable, _cells(F.col("lat"), F.col("lon"), False)[0])}) for x in (portal, places))
    parts = max(1, -(-kinds.records // PART_ROWS))

    def rows(x: DataFrame, what: Column, cell: str, at: str) -> DataFrame:
        """``cell``: where the row goes, or where that is null, ``at`` tells; kept is ``at``."""
        where = cell if at == "v" else at
        part = F.pmod(F.when(F.col(cell).isNull(), F.col(at)).otherwise(F.xxhash64(F.col(cell))), F.lit(parts)).cast("int").alias("part")
        text = F.concat_ws(SEPARATOR, *[F.coalesce(c, F.lit("")) for c in TEXTS])
        return x.select(part, (what * 2 + F.col("own").cast("int")).cast("byte").alias("what"), "v", F.col(where).alias("at"), "lat", "lon", text.alias("text"))

    reached = lambda x, lat="lat", lon="lon": x.filter(F.col(lat).isNotNull()).withColumn("near", F.explode(_cells(F.col(lat), F.col(lon), True)))
    findable = (F.col("rare") != "") | (F.col("street") != "")
    o, m = _far_keys(portal, kinds, PORTAL), _far_keys(places, kinds, MAP)
    far = o.select("key", "v", "lat", "lon").join(m.select("key", F.col("v").alias("aim"), F.col("cell").alias("m_cell")), "key")
    # Those of equal name in a cell within reach are found there.
    far = far.filter(F.col("m_cell").isNull() | F.col("lat").isNull() | F.isnan("lat") | ~F.array_contains(_cells(F.col("lat"), F.col("lon"), True), F.col("m_cell"))).select("v", "aim", "m_cell")
    o_versions, m_versions = _versions(portal, "portal-versions", "lat", "lon"), _versions(places, "places-versions", "cell")
    far = far.join(o_versions.select("v", "last"), "v", "left").select(F.coalesce("last", "v").alias("v"), "aim", "m_cell", F.col("last").isNotNull().alias("anew"))
    own = ["own", *TEXTS, "lat", "lon"]
    late = lambda versions, x: versions.join(x.select(F.col("v").alias("last"), *own), "last")
    every = rows(reached(portal.filter(findable)), F.lit(NEAR), "near", "v")
    for x in (
        rows(places.filter(findable), F.lit(ELEMENT), "cell", "v"),
        rows(far.join(portal.select("v", *own), "v"), F.when(F.col("anew"), ANEW).otherwise(AIMED), "m_cell", "aim"),
        rows(reached(late(o_versions.withColumnsRenamed({"lat": "o_lat", "lon": "o_lon"}), portal), "o_lat", "o_lon"), F.lit(VERSIONS), "near", "v"),
        rows(late(m_versions, places), F.lit(VERSIONS), "cell", "v"),
    ):
        every = every.unionByName(x)

    names = ["o_id", "m_id", *[c.split()[0] for c in LIKENESS.split(", ")], "label", "sort", "anew"]
    schema = f"o_id string, m_id string, {LIKENESS}, label tinyint, sort tinyint, anew boolean"
    fits: dict = {}

    def compare(t: pa.Table) -> pa.Table:
        what, v = t.column("what").to_numpy(), t.column("v").to_numpy()
        own, what = what % 2 == 1, what // 2
        texts = pc.split_pattern(t.column("text").combine_chunks(), SEPARATOR, max_splits=len(TEXTS) - 1).flatten()
        texts = {c: texts.take(pa.array(np.arange(i, len(texts), len(TEXTS)))) for i, c in enumerate(TEXTS)}
        number = pc.if_else(pc.equal(texts["number"], ""), pa.scalar(None, pa.string()), texts["number"])
        t = pa.table({**texts, "number": number, "own": own, "cell": t.column("at"), "lat": t.column("lat"), "lon": t.column("lon")})
        once = lambda i, *by: i[np.unique(keyed(0, *[c[i] for c in by]), return_index=True)[1]]
        near, elements, aimed, versions = (np.flatnonzero(np.isin(what, w)) for w in (NEAR, ELEMENT, (AIMED, ANEW), VERSIONS))
        elements = once(elements, v)
        placed = elements[t.column("lat").is_valid().to_numpy()[elements]]
        at = t.column("cell").fill_null(0).to_numpy()
        near, aimed = once(near, v, at), once(aimed, v, at)
        o, m = blocks(t.take(pa.array(near)), t.take(pa.array(placed)), kinds)
        i, j = equal_pairs(at[aimed], v[elements])
        o, m = np.concatenate([near[o], aimed[i]]), np.concatenate([placed[m], elements[j]])
        # Compared are the latest attributes.
        latest, anew = np.arange(len(v)), what == ANEW
        old, new = equal_pairs(v, v[versions])
        latest[old], anew[old] = versions[new], True
        anew[aimed] = what[aimed] == ANEW
        again, o, m = anew[o] | anew[m], latest[o], latest[m]
        out = []
        for s in range(0, len(o), PAIRS_AT_ONCE):
            a, b = o[s : s + PAIRS_AT_ONCE], m[s : s + PAIRS_AT_ONCE]
            x = likeness(t, a, b, kinds, fits)
            f, label = features(x)
            # Three sorts: positive, negative though the name or the address agrees, and the many other negative ones.
            agrees = f[:, [FEATURES.index("name_high"), FEATURES.index("addr")]].any(axis=1)
            sort = np.where(label == 1, 0, np.where(agrees, 1, 2)).astype(np.int8)
            null = lambda c: pa.array(c, from_pandas=True) if c.dtype == np.float32 else pa.array(c)
            out.append(pa.Table.from_arrays([t.column("id").take(pa.array(a)), t.column("id").take(pa.array(b)), *[null(c) for c in (x[n] for n in names[2:-3])], pa.array(label), pa.array(sort), pa.array(again[s : s + PAIRS_AT_ONCE])], names=names))
        kind = {"string": pa.string(), "float": pa.float32(), "tinyint": pa.int8(), "boolean": pa.bool_()}
        return pa.concat_tables(out) if out else pa.schema([(c.split()[0], kind[c.split()[1]]) for c in schema.split(", ")]).empty_table()

    x = materialise(every.groupBy("part").applyInArrow(compare, schema), "pairs", compression="zstd")
    once = x.drop("anew")
    if not o_versions.isEmpty() or not m_versions.isEmpty():
        once = x.filter("not anew").unionByName(x.filter("anew").dropDuplicates(["o_id", "m_id"])).drop("anew")
    return once


def candidates(portal: DataFrame, places: DataFrame, kinds: Kinds) -> DataFrame:
    """Distinct pairs (``oh``, ``mh``: hashes of the ids) that share a block."""
    return _compared(portal, places, kinds).select(F.xxhash64("o_id").alias("oh"), F.xxhash64("m_id").alias("mh"))


# Two made pairs, one that agrees in all and one that differs in all, so that a model can be fitted to any tables.
AGREE = {"bias": 1, "name": 1, "name_high": 1, "stem_same": 1, "kind": 2, "kind_same": 1, "street": 1, "number_same": 1, "near": 1, "close": 1, "name_near": 1, "name_addr": 1, "addr": 1, "addr_near": 1, "street_spot": 1}
DIFFER = {"bias": 1, "name": 0.2, "name_low": 1, "stem_other": 1, "kind": -1, "kind_low": -1, "kind_other": 1, "street": 0.2, "street_low": 1, "number_other": 1, "far": 1}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Coefficients of a ridge-regularised logistic model of weighted rows, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def prepare(ods: DataFrame, osm: DataFrame) -> tuple[DataFrame, DataFrame, Kinds]:
    """Comparable attributes of the rows of both tables, and the kinds that go together."""
    a, b = (materialise(x, name) for x, name in ((portal_records(ods), "portal-read"), (map_records(osm), "places-read")))  # read three times
    columns = ("name", "cats", "street")
    known = learn(a.select(F.lit(PORTAL).alias("side"), *columns).unionByName(b.select(F.lit(MAP).alias("side"), *columns)))
    box = region(a.select("lat", "lon").unionByName(b.select("lat", "lon")))
    portal, places = (materialise(own_names(placed(attributes(x, side, known), box)), name, compression="zstd").withColumn("h", F.xxhash64("id")) for x, side, name in ((a, PORTAL, "portal"), (b, MAP, "places")))
    for x in (a, b):
        drop(x)
    return portal, places, learn_kinds(portal, places, known)


def match(ods: DataFrame, osm: DataFrame, train_rows: int = TRAIN_ROWS, least: float = 0.0) -> DataFrame:
    """``ods_source_id, osm_source_id, confidence`` of every candidate pair of at least ``least``; a record may be in several.

    Every record with a source_id takes part, the latest row of each; null and empty attributes count as not stated.
    Empty tables give no pairs. The model is fitted on at most about ``train_rows`` weakly labelled pairs chosen
    by hash, and on two made ones, so that tables with labels of one sort only have a model too; every candidate is scored.
    """
    portal, places, kinds = prepare(ods, osm)
    scored = _compared(portal, places, kinds)
    labelled = scored.filter("label >= 0")
    counts = defaultdict(int, {r["sort"]: r["count"] for r in labelled.groupBy("sort").count().collect()})
    share = [min(1.0, train_rows / 3 / max(counts[k], 1)) for k in range(3)]
    unit = F.pmod(F.xxhash64(F.xxhash64("o_id"), F.xxhash64("m_id")), F.lit(1 << 30)) / float(1 << 30)
    alike = [c.split()[0] for c in LIKENESS.split(", ")]
    sample = labelled.filter(unit < F.element_at(F.array(*map(F.lit, share)), F.col("sort") + 1)).select(*alike, "label", "sort", F.xxhash64("o_id").alias("oh")).toPandas()
    x, y = made_pairs()
    held, weight = np.zeros(len(y), dtype=bool), np.ones(len(y))
    if len(sample):
        x, y = np.concatenate([x, features({c: sample[c].to_numpy() for c in alike})[0]]), np.concatenate([y, sample["label"].to_numpy().astype(float)])
        held = np.concatenate([held, sample["oh"].to_numpy() % 3 == 0])
        weight = np.concatenate([weight, 1 / np.array(share)[sample["sort"].to_numpy()]])
    w = fit_logistic(x[~held], y[~held], np.ones(len(y))[~held])
    # Platt scaling; each pair counts for as many as it was drawn from, so the odds are those of all pairs.
    calibrate = held if len(set(y[held])) == 2 else ~held
    s = x[calibrate] @ w
    a, b = fit_logistic(np.stack([s, np.ones(len(s))], axis=1), y[calibrate], weight[calibrate], ridge=1e-2)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            values = features({c: r.column(r.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in alike})[0] @ w
            confidence = 1 / (1 + np.exp(-(values * a + b)))
            scores = pa.RecordBatch.from_arrays([r.column(0), r.column(1), pa.array(confidence)], names=["ods_source_id", "osm_source_id", "confidence"])
            yield scores.filter(pa.array(confidence >= least))

    return scored.select("o_id", "m_id", *alike).mapInArrow(score, "ods_source_id string, osm_source_id string, confidence double")


def made_pairs() -> tuple[np.ndarray, np.ndarray]:
    return np.array([[float(p.get(n, 0)) for n in FEATURES] for p in (AGREE, DIFFER)]), np.array([1.0, 0.0])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched pairs with their confidence."""
    return match(load(spark, sf_dir, "ods_pois"), load(spark, sf_dir, "overpass"), least=MATCH).withColumn("confidence", F.round("confidence", 4))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("ods_source_id", "osm_source_id")
