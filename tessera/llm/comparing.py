"""Candidate pairs among the records of one part of the map, and how alike their attributes are.

All of it is arithmetic on arrays: records come as Arrow tables, blocks are joined by sorting hashes,
and edit distances are worked out for many pairs at once.
"""

from __future__ import annotations

from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.naming import NAME_BANDS, STREET_BANDS, _mix, letters, minhash

ALL_BANDS = 3  # name bands of every record; the others are for elements without a street
TELLS = 0.7  # log of how much more often (or less) than by chance two kinds must meet to say anything
PORTAL, MAP = 0, 1
SHORT = 60  # letters up to which texts are compared in bulk
AT_ONCE = 2_048
PAIRS_AT_ONCE = 200_000

FEATURES = ("bias", "name", "name_high", "name_low", "name_none", "stem_same", "stem_other", "kind", "kind_low", "kind_same", "kind_other", "street", "street_low", "street_none", "number_same", "number_other", "near", "close", "far", "pos_none", "name_near", "name_addr", "addr", "addr_near", "street_spot")
#: What is kept of a pair: similarities that don't apply are NaN; ``number`` is 1 for equal ones, 0 for others, -1 where one is missing.
LIKENESS = "s_name float, s_stem float, s_street float, number tinyint, dist float, high float, low float"


def keyed(tag: int, *parts: np.ndarray) -> np.ndarray:
    """A hash of each row's parts."""
    with np.errstate(over="ignore"):
        return reduce(lambda x, p: _mix(x * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.int64).view(np.uint64)), parts, np.full(len(parts[0]), tag, np.uint64))


def equal_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal values in both arrays."""
    order = np.argsort(b, kind="stable")
    b = b[order]
    first = np.searchsorted(b, a)
    n = np.searchsorted(b, a, side="right") - first
    i = np.repeat(np.arange(len(a)), n)
    return i, order[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(a) else i


class Texts:
    """Distinct texts as a matrix of letters; ``codes`` has the number of each row's text."""

    def __init__(self, column: pa.Array):
        d = column.combine_chunks().dictionary_encode() if isinstance(column, pa.ChunkedArray) else column.dictionary_encode()
        self.codes, self.distinct = d.indices.to_numpy(zero_copy_only=False), d.dictionary
        found, self.size = letters(self.distinct)
        width = min(int(self.size.max(initial=0)), SHORT)
        if self.size.max(initial=0) > width:
            found = found[np.arange(len(found)) - np.repeat(np.cumsum(self.size) - self.size, self.size) < width]
        there = np.zeros(int(found.max(initial=0)) + 2, np.uint32)
        there[found] = 1
        number = np.cumsum(there)
        self.rows = np.zeros((len(self.distinct), width), np.uint16 if number[-1] < 1 << 16 else np.uint32)
        self.rows[np.arange(width)[None, :] < np.minimum(self.size, width)[:, None]] = number[found]

    @cached_property
    def texts(self) -> list[str]:
        return self.distinct.to_pylist()

    def edits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Levenshtein distances of pairs of texts, by their numbers; each distinct pair is compared once."""
        pairs, back = np.unique(np.minimum(a, b).astype(np.int64) * len(self.size) + np.maximum(a, b), return_inverse=True)
        a, b = pairs // max(len(self.size), 1), pairs % max(len(self.size), 1)
        swap = self.size[a] > self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        out = np.where(self.size[a] == 0, self.size[b], 0)
        todo = np.flatnonzero((a != b) & (self.size[a] > 0))
        long = self.size[b[todo]] > SHORT
        for i in todo[long]:
            out[i] = _edits_long(self.texts[a[i]], self.texts[b[i]])
        todo = todo[~long]
        todo = todo[np.lexsort((self.size[b[todo]], self.size[a[todo]]))]
        for s in range(0, len(todo), AT_ONCE):
            part = todo[s : s + AT_ONCE]
            out[part] = self._bulk(a[part], b[part])
        return out[back]

    def _bulk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        la, lb = self.size[a], self.size[b]
        wa, wb = int(la.max()), int(lb.max())
        x, y = np.ascontiguousarray(self.rows[a, :wa].T), np.ascontiguousarray(self.rows[b, :wb].T)
        # Row i, less the column's number: then a letter put in costs nothing.
        e, t, same = (np.zeros((wb + 1, len(a)), np.int16) for _ in range(3))
        out = np.zeros(len(a), np.int64)
        for i in range(1, wa + 1):
            np.equal(x[i - 1], y, out=same[1:], casting="unsafe")
            np.subtract(e[:-1], same[1:], out=t[1:])
            np.minimum(t[1:], e[1:] + np.int16(1), out=t[1:])
            t[0] = i
            for j in range(1, wb + 1):
                np.minimum(t[j], t[j - 1], out=t[j])
            e, t = t, e
            done = np.flatnonzero(la == i)
            out[done] = e[lb[done], done] + lb[done]
        return out

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 1 - self.edits(a, b) / np.maximum(np.maximum(self.size[a], self.size[b]), 1)


def _edits_long(a: str, b: str) -> int:
    x, y = (np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32) for t in (a, b))
    at = np.arange(len(y) + 1)
    row = np.zeros(len(y) + 1, np.int64)  # less the column's number
    for i, c in enumerate(x, 1):
        row = np.minimum.accumulate(np.concatenate([[i], np.minimum(row[:-1] - (y == c), row[1:] + 1)]))
    return int(row[-1] + at[-1])


def blocks(portal: pa.Table, places: pa.Table, kinds) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both tables (``cell, rare, street, sig``) that share a block of a cell, each pair once.

    Elements of a kind that none of the portal's goes with must have the very name, or be in a street with a place whose
    kind isn't known; others share a MinHash value of name or street, and those without a street, which have but the
    name to be found by, one of more bands of names.
    """
    both = pa.concat_tables([t.select(["cell", "rare", "street", "sig"]) for t in (portal, places)])
    side = np.arange(both.num_rows) >= portal.num_rows
    column = lambda c: both.column(c).combine_chunks()
    cell, rare, street = column("cell").to_numpy(zero_copy_only=False), column("rare").dictionary_encode(), column("street").dictionary_encode()
    values = lambda d, bands, dull: [v.fill_null(0).to_numpy(zero_copy_only=False)[d.indices.to_numpy(zero_copy_only=False)] for v in minhash(d.dictionary, bands, dull)]
    name_values, street_values = values(rare, NAME_BANDS, None), values(street, STREET_BANDS, kinds.dull)
    empty = lambda d: pc.equal(d.dictionary, "").take(d.indices).to_numpy(zero_copy_only=False)
    named, bare = ~empty(rare), empty(street)
    sigs = column("sig").dictionary_encode()
    texts, sig = sigs.dictionary.to_pylist(), sigs.indices.to_numpy(zero_copy_only=False)
    foreign = np.zeros(len(sig), bool)
    for s in (PORTAL, MAP):
        mine = np.flatnonzero(side == s)
        odd = np.zeros(len(texts), bool)
        for i in np.unique(sig[mine]):
            odd[i] = "-" in kinds.classes(texts[i], s)
        foreign[mine] = odd[sig[mine]]
    keys, rows = [], []

    def add(tag: int, value: np.ndarray, who: np.ndarray) -> None:
        at = np.flatnonzero(who)
        keys.append(keyed(tag, cell[at], value[at]))
        rows.append(at)

    add(9, rare.indices.to_numpy(zero_copy_only=False), named & (~side | foreign))
    for i, v in enumerate(name_values):
        add(i, v, named & (~side | (~foreign & (bare | (i < ALL_BANDS)))))
    for i, v in enumerate(street_values):
        add(10 + i, v, ~bare & (~side | ~foreign))
        add(15 + i, v, ~bare & foreign)
    key, row = np.concatenate(keys), np.concatenate(rows)
    mine = row >= portal.num_rows
    o, m = equal_pairs(key[~mine], key[mine])
    pairs = np.unique(row[~mine][o].astype(np.int64) * max(places.num_rows, 1) + (row[mine][m] - portal.num_rows))
    return pairs // max(places.num_rows, 1), pairs % max(places.num_rows, 1)


def likeness(rows: pa.Table, o: np.ndarray, m: np.ndarray, kinds, known: dict) -> dict[str, np.ndarray]:
    """Similarities of places ``o`` with elements ``m`` of ``rows``; ``known`` keeps how kinds fit."""
    # Only rows that are in a pair are looked at.
    there = np.zeros(rows.num_rows, bool)
    there[o] = there[m] = True
    number = np.cumsum(there) - 1
    rows, o, m = rows.select(["own", "core", "rare", "street", "number", "lat", "lon", "sig"]).take(pa.array(np.flatnonzero(there))), number[o], number[m]

    def texts(column: pa.ChunkedArray) -> tuple[Texts, np.ndarray, np.ndarray]:
        t = Texts(column.fill_null(""))
        return t, t.codes[o], t.codes[m]

    own = rows.column("own").fill_null(False).to_numpy()
    named = own[o] & own[m]
    out = {c: np.full(len(o), np.nan) for c in ("s_name", "s_stem", "s_street")}
    core, a, b = texts(rows.column("core"))
    out["s_name"][named] = core.similarity(a[named], b[named])
    stems = []
    for column in (rows.column("rare"), pc.replace_substring_regex(rows.column("rare"), r"^.* ", "")):
        t, a, b = texts(column)
        stems.append(t.similarity(a[named], b[named]))
    out["s_stem"][named] = np.maximum(*stems)
    street, a, b = texts(rows.column("street"))
    stated = (street.size[a] > 0) & (street.size[b] > 0)
    a, b = a[stated], b[stated]
    alike = street.similarity(a, b)
    # One that is the other's beginning is its abbreviation.
    shorter, longer = np.minimum(street.size[a], street.size[b]), np.maximum(street.size[a], street.size[b])
    short = np.flatnonzero((shorter >= 5) & (longer - shorter <= 6) & (alike < 0.95))
    short = short[(street.rows[a[short], :5] == street.rows[b[short], :5]).all(axis=1)]
    begins = ((street.rows[a[short]] == street.rows[b[short]]) | (np.arange(street.rows.shape[1]) >= shorter[short, None])).all(axis=1)
    for i in np.flatnonzero(begins & (shorter[short] > street.rows.shape[1])):
        x, y = (street.distinct[int(t[short[i]])].as_py() for t in (a, b))
        begins[i] = x.startswith(y) or y.startswith(x)
    alike[short[begins]] = 0.95
    out["s_street"][stated] = alike
    number = rows.column("number").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    a, b = number[o], number[m]
    out["number"] = np.where((a < 0) | (b < 0), -1, a == b)
    lat, lon = (rows.column(c).to_numpy() for c in ("lat", "lon"))
    dx = np.abs(lon[o] - lon[m])
    out["dist"] = 111_195.0 * np.sqrt((lat[o] - lat[m]) ** 2 + (np.minimum(dx, 360 - dx) * np.cos(np.radians(lat[o]))) ** 2)
    sig, a, b = texts(rows.column("sig"))
    pairs, back = np.unique(a.astype(np.int64) * max(len(sig.texts), 1) + b, return_inverse=True)
    fits = []
    for p in pairs:
        key = sig.texts[p // len(sig.texts)], sig.texts[p % len(sig.texts)]
        if key not in known:
            known[key] = kinds.fit(*key)
        fits.append(known[key])
    fits = np.array(fits, dtype=float).reshape(-1, 2)
    out["high"], out["low"] = fits[back, 0], fits[back, 1]
    return {c: v.astype(np.int8 if c == "number" else np.float32) for c, v in out.items()}


def features(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A row of ``FEATURES`` for each pair, and its weak label (-1: none), from the likeness of its attributes."""
    s_name, s_stem, s_street, dist, high, low = (x[c].astype(float) for c in ("s_name", "s_stem", "s_street", "dist", "high", "low"))
    same_number, number_other = x["number"] == 1, x["number"] == 0
    none, nowhere = np.isnan(s_name), np.isnan(dist)
    addr = (s_street >= 0.8) & same_number
    other = low < -TELLS
    same = (high >= TELLS) & ~other
    close, far = dist < 250, dist > 400
    # Kinds that say nothing are at both ends at once (3 and -3), where hardly any others are: a mark of its own to the model.
    value = {
        "bias": np.ones(len(dist)), "name": np.where(none, 0.5, s_name), "name_high": s_name >= 0.85, "name_low": s_name < 0.6, "name_none": none,
        "stem_same": s_stem >= 0.8, "stem_other": s_stem < 0.6, "kind": np.fmin(high, 3), "kind_low": np.fmax(low, -3), "kind_same": same, "kind_other": other,
        "street": np.where(np.isnan(s_street), 0.5, s_street), "street_low": s_street < 0.7, "street_none": np.isnan(s_street), "number_same": same_number, "number_other": number_other,
        "near": np.where(nowhere, 0.2, np.exp(-np.where(nowhere, 0, dist) / 150)), "close": close, "far": far, "pos_none": nowhere, "name_near": (s_name >= 0.75) & close, "name_addr": (s_name >= 0.75) & (s_street >= 0.8),
        "addr": addr, "addr_near": addr & close, "street_spot": (s_street >= 0.85) & ~number_other & (dist < 60),
    }
    good_name, bad_name = (s_name >= 0.85) & (s_stem >= 0.8), (s_name < 0.55) | (s_stem < 0.5)
    good_street = (s_street >= 0.85) & ~number_other
    # Weak labels: several attributes that agree, or one that rules the pair out.
    rules = (
        (other | (far & ~(good_name & addr)), 0),
        (bad_name & (~addr | ((s_name < 0.5) & (s_stem < 0.5))), 0),
        (nowhere & np.isnan(s_street) & ~good_name, 0),
        (number_other & ~good_name & ~none, 0),
        (none & (number_other | (s_street < 0.6)), 0),
        (~good_name & ~good_street & ~addr & (dist > 150) & (s_stem < 0.7), 0),
        (good_name & (close | addr | good_street), 1),
        (none & addr & (same | np.isnan(high)), 1),
        (none & good_street & same & (dist < 60), 1),
    )
    label = np.select([r for r, _ in rules], [v for _, v in rules], -1).astype(np.int8)
    return np.stack([value[n].astype(float) for n in FEATURES], axis=1) if len(dist) else np.empty((0, len(FEATURES))), label
