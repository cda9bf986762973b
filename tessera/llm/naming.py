"""What the names, categories and streets of two tables have in common, learnt from the tables themselves.

Three things are learnt, each from all rows: the words (and categories) that so many records share that
they tell no places apart; which of these words say what kind of place a record is, since they go with
one category; and the letter groups that many street names share. What is learnt is bounded: words and
categories have a share of at least ``SHARE`` of a table's records, so there are at most
(mean number a record) / ``SHARE`` of them, and letter groups are numbers below 65,536.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 0.002  # words and categories of this share of a table's records are common
GRAM_SHARE = 0.06  # letter groups of this share of the streets say nothing
PURE = 0.5  # a common word of which this share goes with one category says the kind
ONE_SIDED = 0.1  # a common word that is this much rarer in the other table is a habit of its table
LONG = 8  # letters from which on a word is taken for a misspelling of a common one
FLUSH = 200_000
BUCKETS = 1 << 16
NAME_BANDS, STREET_BANDS = 5, 2


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# The hash of every bucket of letter groups in each band.
HASHES = [(_mix(np.arange(BUCKETS) + (band + 1) * BUCKETS) % np.uint64((1 << 31) - 1)).astype(np.int64) for band in range(max(NAME_BANDS, STREET_BANDS))]
TOP = np.int64((1 << 31) - 1)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The values in order; sorting is faster than the hashing of ``np.unique``."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The letters of all texts one after the other, and how many each text has."""
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_buffer()
    if len(text) == size.sum():
        return np.frombuffer(text, dtype=np.uint8), size
    return np.frombuffer(str(text, "utf-8").encode("utf-32-le"), dtype=np.uint32), size


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every three letters in a row of texts, each text with a blank on either side."""
    inner, size = letters(texts)
    codes = np.full(len(inner) + 2 * len(size), ord(" "), np.uint64)
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row = np.repeat(np.arange(len(size)), size + 2)
    codes[np.arange(len(inner)) + 2 * np.repeat(np.arange(len(size)), size) + 1] = inner
    with np.errstate(over="ignore"):
        mixed = _mix(codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:])
    whole = row[:-2] == row[2:]
    return row[:-2][whole], (mixed[whole] >> np.uint64(48)).astype(np.int64)


def _least(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    """The least value of each row, which come in the order of rows; ``TOP`` where a row has none."""
    out = np.full(rows, TOP)
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.minimum.reduceat(values, first)
    return out


def minhash(texts: pa.Array, bands: int, dull: np.ndarray | None = None) -> list[pa.Array]:
    """``bands`` MinHash values of each text's letter groups, null for an empty text; ``dull`` groups count only where there are no others."""
    d = texts.dictionary_encode()
    row, code = grams(d.dictionary)
    if dull is not None:
        keen = ~dull[code]
        only = np.ones(len(d.dictionary), bool)
        only[row[keen]] = False
        keen |= only[row]
        row, code = row[keen], code[keen]
    out = []
    for h in HASHES[:bands]:
        least = _least(row, h[code], len(d.dictionary))
        out.append(pa.array(least, mask=least == TOP).cast(pa.int32()).take(d.indices))
    return out


def split(names: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, words) of a column of names whose words stand between single blanks; empty names have none."""
    lists = pc.split_pattern(names, " ")
    words = lists.flatten()
    row = np.repeat(np.arange(len(names)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    there = pc.not_equal(words, "")
    return row[there.to_numpy(zero_copy_only=False)], words.filter(there)


def _grouped(row: np.ndarray, values: pa.Array, rows: int, by: str) -> pa.Array:
    """The values of each row, which come in the order of rows, joined."""
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values), by)


def _listed(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), n), lists.flatten()


def _numbered(values: pa.Array, of: dict[str, int]) -> np.ndarray:
    """The number of each value, -1 for others."""
    at = pc.index_in(values, value_set=pa.array(list(of), pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
    return np.array([*of.values(), -1], dtype=np.int64)[at]


COUNTS = "what string, side int, key string, other string, n long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, int], list[pa.StructArray]] = {}
    groups = np.zeros(BUCKETS, np.int64)
    records: Counter = Counter()
    streets = held = 0

    def batch(what: str, side: int, key: pa.Array, n: pa.Array) -> pa.RecordBatch:
        same = lambda v, kind: pa.repeat(pa.scalar(v, kind), len(key))
        return pa.RecordBatch.from_arrays([same(what, pa.string()), same(side, pa.int32()), key, same("", pa.string()), n], names=["what", "side", "key", "other", "n"])

    def merge() -> int:
        """Counts of the same value as one; how many there are."""
        for k, counts in seen.items():
            t = pa.Table.from_arrays([pa.chunked_array([c.field(i) for c in counts], t) for i, t in ((0, pa.string()), (1, pa.int64()))], names=["values", "counts"])
            t = t.group_by("values", use_threads=False).aggregate([("counts", "sum")]).combine_chunks()
            seen[k] = [pa.StructArray.from_arrays([c.combine_chunks() for c in (t.column("values"), t.column("counts_sum"))], ["values", "counts"])]
        return sum(len(c) for counts in seen.values() for c in counts)

    def out() -> Iterator[pa.RecordBatch]:
        for (what, side), counts in seen.items():
            yield from (batch(what, side, c.field(0), c.field(1)) for c in counts)
        seen.clear()

    for b in batches:
        side = b.column("side").to_numpy(zero_copy_only=False)
        for s in np.unique(side):
            mine = b.filter(pa.array(side == s))
            records[int(s)] += mine.num_rows
            for what, values in (("word", split(mine.column("name"))[1]), ("category", _listed(mine.column("cats"))[1])):
                if len(values):
                    counts = pc.value_counts(values)
                    seen.setdefault((what, int(s)), []).append(counts)
                    held += len(counts)
        # Each street counts once for a letter group, as often as it occurs.
        d = b.column("street").dictionary_encode()
        row, code = grams(d.dictionary)
        if len(row):
            times = np.bincount(d.indices.to_numpy(zero_copy_only=False), minlength=len(d.dictionary))
            both = _distinct(row * BUCKETS + code)
            np.add.at(groups, both % BUCKETS, times[both // BUCKETS])
            streets += int(times[_distinct(row)].sum())
        if held > FLUSH:
            held = merge()
            if held > FLUSH / 2:
                yield from out()
                held = 0
    merge()
    yield from out()
    for s, n in records.items():
        yield batch("records", s, pa.array([""]), pa.array([n], pa.int64()))
    yield batch("streets", 0, pa.array([""]), pa.array([streets], pa.int64()))
    there = np.flatnonzero(groups)
    yield batch("gram", 0, pa.array(there).cast(pa.string()), pa.array(groups[there]))


@dataclass
class Learnt:
    """Words and categories by table (0 and 1): numbers of the features, and what else a name's words are."""

    common: list[set[str]] = field(default_factory=lambda: [set(), set()])
    habits: list[set[str]] = field(default_factory=lambda: [set(), set()])
    features: list[dict[str, int]] = field(default_factory=lambda: [{}, {}])  # "c:category" or "w:word" -> number
    counts: list[dict[str, int]] = field(default_factory=lambda: [{}, {}])  # how many records have a feature
    records: list[int] = field(default_factory=lambda: [0, 0])
    dull: np.ndarray | None = None

    def kinds(self, side: int) -> set[str]:
        return {f[2:] for f in self.features[side] if f.startswith("w:")}


def _sure(n: int, total: int, share: float) -> bool:
    """Whether the share is reached beyond chance (two standard deviations), so that a handful in a small table doesn't count."""
    return n - 2 * n**0.5 >= share * total


def learn(rows: DataFrame) -> Learnt:
    """From ``rows``: ``side int, name string, cats array<string>, street string`` of both tables."""
    n = rows.mapInArrow(_counted, COUNTS).groupBy("what", "side", "key").agg(F.sum("n").alias("n"))
    n = n.persist()
    totals = {(r["what"], r["side"]): r["n"] for r in n.filter("what in ('records', 'streets')").collect()}
    records = [totals.get(("records", s), 0) for s in (0, 1)]
    floor = F.when(F.col("side") == 0, SHARE * records[0]).otherwise(SHARE * records[1])
    often = n.filter(F.col("what").isin("word", "category") & (F.col("n") - 2 * F.sqrt("n") >= floor)).collect()
    known = Learnt(records=records)
    cat_counts = {(r["side"], r["key"]): r["n"] for r in often if r["what"] == "category"}
    cats: list[list[str]] = [sorted(r["key"] for r in often if r["what"] == "category" and r["side"] == s) for s in (0, 1)]
    counts = {(r["side"], r["key"]): r["n"] for r in often if r["what"] == "word"}
    known.common = [{w for s, w in counts if s == side} for side in (0, 1)]
    # The share of a common word in the other table, where it may be rare.
    elsewhere = {(r["side"], r["key"]): r["n"] for r in n.filter((F.col("what") == "word") & F.col("key").isin(sorted({w for _, w in counts}))).collect()} if counts else {}
    known.dull = np.zeros(BUCKETS, bool)
    for r in n.filter((F.col("what") == "gram") & (F.col("n") >= GRAM_SHARE * totals.get(("streets", 0), 0))).collect():
        if _sure(r["n"], totals["streets", 0], GRAM_SHARE):
            known.dull[int(r["key"])] = True
    n.unpersist()
    together = _together(rows, known.common, cats)
    for side in (0, 1):
        pure = {w for w in known.common[side] if together.get((side, w), 0) >= PURE * counts[side, w]}
        known.features[side] = {f: i for i, f in enumerate([f"c:{c}" for c in cats[side]] + [f"w:{w}" for w in sorted(pure)])}
        known.counts[side] = {f"c:{c}": cat_counts[side, c] for c in cats[side]} | {f"w:{w}": counts[side, w] for w in pure}
        other = 1 - side
        rarer = lambda w: elsewhere.get((other, w), 0) / max(records[other], 1) < ONE_SIDED * counts[side, w] / max(records[side], 1)  # noqa: E731, B023
        known.habits[side] = {w for w in known.common[side] - pure if rarer(w)}
    return known


def _together(rows: DataFrame, common: list[set[str]], cats: list[list[str]]) -> dict[tuple[int, str], int]:
    """For each common word of a table, how many of its records have the category it goes with most."""
    words, numbers = [sorted(c) for c in common], [{c: i for i, c in enumerate(x)} for x in cats]
    at = [{w: i for i, w in enumerate(x)} for x in words]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros((len(words[s]), len(cats[s])), np.int64) for s in (0, 1)]
        for b in batches:
            side = b.column("side").to_numpy(zero_copy_only=False)
            for s in np.unique(side):
                mine = b.filter(pa.array(side == s))
                wr, w = split(mine.column("name"))
                cr, c = _listed(mine.column("cats"))
                w, c = _numbered(w, at[s]), _numbered(c, numbers[s])
                wr, w, cr, c = wr[w >= 0], w[w >= 0], cr[c >= 0], c[c >= 0]
                # Each word beside each category of its record.
                first = np.searchsorted(cr, wr)
                n = np.searchsorted(cr, wr, side="right") - first
                which = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
                np.add.at(seen[s], (np.repeat(w, n), c[which]), 1)
        for s in (0, 1):
            i, j = np.nonzero(seen[s])
            yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(i), pa.string()), pa.array([s] * len(i), pa.int32()), pa.array([words[s][k] for k in i], pa.string()), pa.array([cats[s][k] for k in j], pa.string()), pa.array(seen[s][i, j], pa.int64())], names=["what", "side", "key", "other", "n"])

    if not any(words) or not any(cats):
        return {}
    best = rows.mapInArrow(count, COUNTS).groupBy("side", "key", "other").agg(F.sum("n").alias("n")).groupBy("side", "key").agg(F.max("n").alias("n"))
    return {(r["side"], r["key"]): r["n"] for r in best.collect()}  # a row for each common word


def deletions(word: str, most: int = 2) -> set[str]:
    """The word without up to ``most`` of its letters, in every way."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


def distance(a: str, b: str) -> int:
    """Edits between two words; exchanged neighbours are one."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        before, row = row, new
    return row[-1]


class Speller:
    """Misspellings of long common words, and such words run together with the next one."""

    def __init__(self, words: set[str], every: set[str] = frozenset()):
        self.words, self.every = {w for w in words if len(w) >= LONG}, every
        self.index: dict[str, list[str]] = {}
        for w in sorted(self.words):
            for d in deletions(w):
                self.index.setdefault(d, []).append(w)
        self.known: dict[str, str] = {}

    def __call__(self, token: str) -> str:
        if len(token) < LONG - 2 or len(token) > 64:
            return token
        if (out := self.known.get(token)) is None:
            out = self.known[token] = self._written(token)
        return out

    def _written(self, token: str) -> str:
        # Run together with another common word?
        for k in range(len(token) - 1, LONG - 1, -1):
            if token[:k] in self.words and token[k:] in self.every:
                return f"{token[:k]} {token[k:]}"
        # Compared by the letters that are left when each side loses up to two; then exactly.
        near = {w for d in deletions(token) for w in self.index.get(d, ())} if len(token) >= LONG - 2 else set()
        good = sorted((distance(token, w), w) for w in near if abs(len(w) - len(token)) <= 2)
        if good and good[0][0] <= 2:
            return good[0][1]
        for k in range(len(token) - 1, LONG - 1, -1):
            if token[:k] in self.words:
                return f"{token[:k]} {token[k:]}"
        return token


ATTRIBUTES = "at long, id string, core string, rare string, sig string, street string, number string, lat double, lon double"


def attributes(rows: DataFrame, side: int, known: Learnt) -> DataFrame:
    """``ATTRIBUTES`` of ``rows`` (``id, at, name, cats, street, number, lat, lon``).

    ``rare``: the words that tell places apart; ``core``: these and the common ones that both tables use
    in names; ``sig``: numbers of the kind words and common categories.
    """
    kinds, features = known.kinds(side), known.features[side]
    # Words that say the kind in either table are none of a name.
    stops, habits = known.common[0] | known.common[1], known.habits[side] | known.habits[1 - side]
    every = known.kinds(0) | known.kinds(1)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = Speller(kinds, stops)
        for b in batches:
            rows_n, name = b.num_rows, b.column("name")
            row, words = split(name)
            d = words.dictionary_encode()
            spelt = d.dictionary.to_pylist()
            has = np.zeros(rows_n, bool)
            if len(words):
                kind = np.array([w in every for w in spelt])[d.indices.to_numpy(zero_copy_only=False)]
                has[row[kind]] = True
                # Only names without a kind word are looked through for a misspelt one.
                lacking = np.unique(d.indices.to_numpy(zero_copy_only=False)[~has[row]])
                new = {i: s for i in lacking if (s := spell(spelt[i])) != spelt[i]}
                if new:
                    texts = np.array(spelt, dtype=object)[d.indices.to_numpy(zero_copy_only=False)]
                    swap = np.flatnonzero(~has[row] & np.isin(d.indices.to_numpy(zero_copy_only=False), list(new)))
                    for i in swap:
                        texts[i] = new[d.indices[i].as_py()]
                    row, words = split(_grouped(row, pa.array(texts, pa.string()), rows_n, " "))
                    d = words.dictionary_encode()
                    spelt = d.dictionary.to_pylist()
            index = d.indices.to_numpy(zero_copy_only=False)
            pick = lambda keep: (lambda m: _grouped(row[m], words.filter(pa.array(m)), rows_n, " "))(np.array([keep(w) for w in spelt], dtype=bool)[index]) if len(words) else pa.array([""] * rows_n)  # noqa: E731, B023
            rare = pick(lambda w: w not in stops)
            core = pick(lambda w: w not in every and w not in habits)
            cr, cats = _listed(b.column("cats"))
            # The features of each row, sorted and distinct.
            f = np.concatenate([_numbered(words, {f[2:]: i for f, i in features.items() if f[0] == "w"}), _numbered(cats, {f[2:]: i for f, i in features.items() if f[0] == "c"})])
            r = np.concatenate([row, cr])
            both = _distinct((r[f >= 0] << 20) | f[f >= 0])
            sig = _grouped(both >> 20, pa.array(both & ((1 << 20) - 1), pa.int64()).cast(pa.string()), rows_n, ",")
            cols = [b.column("at"), b.column("id"), core, rare, sig, b.column("street"), b.column("number"), b.column("lat"), b.column("lon")]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in ATTRIBUTES.split(", ")])

    return rows.select("id", "at", "name", "cats", "street", "number", "lat", "lon").mapInArrow(of, ATTRIBUTES)
