"""Candidates for one entity in two sources, and what becomes of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geo import haversine
from tessera.functions.text import trigrams
from tessera.storage import materialise

MERGE, REVIEW = 0.95, 0.70
GEO_M, NAME_LEAST = 50.0, 0.80
GRAM_BUCKETS = 1 << 16  # of trigrams, whose numbers say which are rare
KEY_ROWS = 200_000  # rows of keys that are compared in one place, about
BULK, UNFOLDED = 1 << 16, 1 << 21  # pairs of one key, and of many, that are compared at once


def geo_confidence(dist: Column, most: float) -> Column:
    """1 at no distance, 0.1 at the greatest; three places."""
    return F.round(F.greatest(F.lit(0.0), 1 - dist / most) * 0.9 + 0.1, 3)


def triage(confidence: Column) -> Column:
    return F.when(confidence >= MERGE, "merge").when(confidence >= REVIEW, "review").otherwise("drop")


def geo_candidates(nodes: DataFrame, most_m: float = GEO_M) -> DataFrame:
    """``node_a_id, node_b_id, dist_m, confidence``: equal type and label (case aside), other source, within ``most_m``.

    The equality makes it a hash join; of the label's rows only those in neighbouring cells meet, so a label that a
    tenth of the rows share doesn't form all its pairs.
    """
    step = most_m / 111_195.0 * 1.001
    n = nodes.filter("valid_to is null and label is not null and lat is not null and lon is not null").select("id", "source", "node_type", F.lower("label").alias("name"), "lat", "lon")

    def cell(dy: int = 0, dx: int = 0) -> Column:
        row = F.floor(F.col("lat") / step) + dy
        # All of a row of cells is as wide as its latitude next to a pole needs; columns go on across the date line.
        most = F.greatest(F.abs(row * step), F.abs((row + 1) * step))
        columns = F.greatest(F.floor(360 * F.cos(F.radians(F.least(most, F.lit(90.0)))) / step), F.lit(1))
        return F.struct(row.alias("r"), F.pmod(F.floor((F.col("lon") + 180) / 360 * columns) + dx, columns).alias("c"))

    a = n.withColumn("cell", F.explode(F.array_distinct(F.array(*[cell(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))))
    b = n.withColumn("cell", cell()).withColumnsRenamed({c: f"b_{c}" for c in ("id", "source", "lat", "lon")})
    x = a.join(b, ["node_type", "name", "cell"]).filter((F.col("id") < F.col("b_id")) & (F.col("source") != F.col("b_source")))
    x = x.withColumn("dist_m", haversine(F.col("lat"), F.col("lon"), F.col("b_lat"), F.col("b_lon"))).filter(F.col("dist_m") <= most_m)
    return x.select(F.col("id").alias("node_a_id"), F.col("b_id").alias("node_b_id"), "dist_m", geo_confidence(F.col("dist_m"), most_m).alias("confidence"))


def similar_labels(nodes: DataFrame, node_type: str, least: float = NAME_LEAST) -> DataFrame:
    """``source_a, label_a, source_b, label_b, n_a, n_b, similarity`` of labels in two sources (source_a < source_b).

    One row per pair of distinct labels, with how many current nodes have each: nodes of equal label are one class. A
    similarity of t needs a shared trigram among the rarest n - ceil(t n) + 1 of either label, so only labels with one of
    these in common are compared; pairs whose sizes or bits rule them out drop there, then the similarity is exact.
    """
    n = nodes.filter((F.col("node_type") == node_type) & F.col("valid_to").isNull() & F.col("label").isNotNull())
    labels = n.groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"))
    labels = materialise(labels.select("source", "label", "n", F.transform(trigrams(F.col("label")), _as_number).alias("grams"), F.xxhash64("source", "label").alias("h")), "labels").filter(F.size("grams") > 0)
    bucket = F.pmod(F.xxhash64("gram"), F.lit(GRAM_BUCKETS))
    often = np.zeros(GRAM_BUCKETS, np.int64)
    for r in labels.select(F.explode("grams").alias("gram")).groupBy(bucket.alias("b")).count().collect():
        often[r["b"]] = r["count"]
    hashed = F.transform("grams", lambda g: F.xxhash64(g))
    keys = labels.select("h", "source", hashed.alias("grams")).mapInArrow(_prefix_keys(often, least), "key long, h long, source string, size int, w0 long, w1 long")
    parts = max(1, -(-labels.count() * 6 // KEY_ROWS))
    pairs = keys.groupBy(F.pmod("key", F.lit(parts)).alias("part")).applyInArrow(_alike(least), "ha long, hb long").distinct()
    la = labels.select(F.col("h").alias("ha"), F.col("grams").alias("ga"))
    lb = labels.select(F.col("h").alias("hb"), F.col("grams").alias("gb"))
    x = pairs.join(la, "ha").join(lb, "hb")
    both = F.size(F.array_intersect("ga", "gb"))
    x = x.select("ha", "hb", (both / (F.size("ga") + F.size("gb") - both)).alias("similarity")).filter(F.col("similarity") >= least - 1e-12)
    na = labels.select(F.col("h").alias("ha"), F.col("source").alias("source_a"), F.col("label").alias("label_a"), F.col("n").alias("n_a"))
    nb = labels.select(F.col("h").alias("hb"), F.col("source").alias("source_b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"))
    return x.join(na, "ha").join(nb, "hb").select("source_a", "label_a", "source_b", "label_b", "n_a", "n_b", "similarity")


def _prefix_keys(often: np.ndarray, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each label (``h, source, grams``: hashes) a row for each of its rarest trigrams, with its size and bits.

    A bit for each trigram in one of two words: sets can't differ by fewer trigrams than their words by bits.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            gram = lists.flatten().to_numpy(zero_copy_only=False)
            start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
            if not len(size):
                continue
            bit = np.left_shift(np.int64(1), gram & 63)
            second = (gram >> 6) & 1 == 1
            words = [np.bitwise_or.reduceat(np.where(mine, bit, 0), start) for mine in (~second, second)]
            # The rarest first, in an order all labels share.
            row = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((gram, often[gram % GRAM_BUCKETS], row))
            gram = gram[order]
            keep = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
            at = np.repeat(np.arange(len(size)), keep)
            key = gram[start[at] + np.arange(len(at)) - np.repeat(np.cumsum(keep) - keep, keep)]
            take = pa.array(at)
            cols = [pa.array(key), batch.column(0).take(take), batch.column(1).take(take), pa.array(size[at].astype(np.int32)), *[pa.array(w[at]) for w in words]]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "h", "source", "size", "w0", "w1"])

    return of


def _alike(least: float) -> Callable[[pa.Table], pa.Table]:
    """Pairs of labels of two sources with a key in common that sizes and bits don't rule out.

    Keys of few pairs are unfolded together; of each other key, blocks of labels are compared as matrices.
    """
    limit = (1 - least) / (1 + least)

    def of(t: pa.Table) -> pa.Table:
        key, h, size, w0, w1 = (t.column(c).to_numpy() for c in ("key", "h", "size", "w0", "w1"))
        w0, w1 = w0.view(np.uint64), w1.view(np.uint64)  # of negative numbers, other bits would be counted
        names = t.column("source").combine_chunks().dictionary_encode()
        rank = np.argsort(np.argsort(np.array(names.dictionary.to_pylist(), dtype=object)))  # as the names are ordered
        source = rank[names.indices.to_numpy()]
        a, b = (rows[np.lexsort((size[rows], key[rows]))] for rows in (np.flatnonzero(source < source.max()), np.flatnonzero(source > 0)))
        found = []

        def test(i: np.ndarray, j: np.ndarray) -> None:
            d = np.bitwise_count(w0[i] ^ w0[j]).astype(np.int64) + np.bitwise_count(w1[i] ^ w1[j])
            ok = (d <= limit * (size[i] + size[j]) + 1e-9) & (size[i] >= size[j] * least - 1e-9) & (size[j] >= size[i] * least - 1e-9) & (source[i] < source[j])
            found.append(np.stack([h[i[ok]], h[j[ok]]], axis=1))

        first, last = np.searchsorted(key[b], key[a]), np.searchsorted(key[b], key[a], side="right")
        met = last > first
        a, first, last = a[met], first[met], last[met]
        # Sizes of a key rise in both: where those of fitting size begin and end.
        group, start = np.unique(key[a], return_index=True)
        stop = np.append(start[1:], len(a))
        big = np.repeat((stop - start) * (last[start] - first[start]) > BULK, stop - start)
        small = np.flatnonzero(~big)
        n = np.cumsum((last - first)[small])
        for s, e in zip(*(lambda c: (np.r_[0, c], np.r_[c, len(small)]))(np.unique(np.searchsorted(n, np.arange(UNFOLDED, n[-1] if len(n) else 0, UNFOLDED))))):
            k = (last - first)[small[s:e]]
            i = np.repeat(small[s:e], k)
            test(a[i], b[first[i] + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)])
        for s, e in zip(start, stop):
            if not big[s]:
                continue
            mine = b[first[s] : last[s]]
            step = max(1, BULK // len(mine))
            for c in range(s, e, step):
                x = a[c : min(c + step, e)]
                lo, hi = np.searchsorted(size[mine], [np.ceil(size[x[0]] * least - 1e-9), np.floor(size[x[-1]] / least + 1e-9) + 1])
                y = mine[lo:hi]
                if len(y):
                    d = np.bitwise_count(w0[x][:, None] ^ w0[y]) + np.bitwise_count(w1[x][:, None] ^ w1[y])
                    i, j = np.nonzero(d <= limit * (int(size[x[-1]]) + int(size[y[-1]])) + 1e-9)
                    test(x[i], y[j])
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pa.table({"ha": pairs[:, 0], "hb": pairs[:, 1]})

    return of


def _as_number(gram: Column) -> Column:
    """A trigram's three code points in one number: compared faster than text, and as exactly."""
    at = lambda i: F.ascii(F.substring(gram, i, 1)).cast("long")
    return at(1) * (1 << 42) + at(2) * (1 << 21) + at(3)


def same_as(pairs: DataFrame, now: Column) -> DataFrame:
    """SAME_AS edges of merged pairs; always inferred."""
    sid = F.concat_ws(":", F.lit("SAME_AS"), "node_a_id", "node_b_id")
    return pairs.select(F.sha2(sid, 256).alias("id"), F.lit("SAME_AS").alias("edge_type"), F.col("node_a_id").alias("from_node_id"), F.col("node_b_id").alias("to_node_id"), F.lit("resolution").alias("source"), sid.alias("source_id"), now.alias("observed_at"), F.lit(True).alias("inferred"), "confidence")


def new_candidates(pairs: DataFrame, there: DataFrame) -> DataFrame:
    """Pairs not among the candidates so far, whatever their method; the surest method of a pair stays."""
    best = pairs.groupBy("node_a_id", "node_b_id").agg(F.max(F.struct("confidence", "method")).alias("b")).select("node_a_id", "node_b_id", "b.confidence", "b.method")
    return best.join(there.select("node_a_id", "node_b_id"), ["node_a_id", "node_b_id"], "left_anti")


def review_queue(candidates: DataFrame, nodes: DataFrame, state: str = "pending", limit: int = 100) -> DataFrame:
    """Candidates of a state with both nodes, surest first. ``resolved`` null is pending, true merged, false rejected."""
    r = F.col("resolved")
    wanted = {"pending": r.isNull(), "merged": r == True, "rejected": r == False, "all": F.lit(True)}[state]  # noqa: E712
    top = candidates.filter(wanted).orderBy(F.desc("confidence"), "node_a_id", "node_b_id").limit(limit)
    n = nodes.filter("valid_to is null")
    a = n.select(F.col("id").alias("node_a_id"), F.col("label").alias("a_label"), F.col("source").alias("a_source"))
    b = n.select(F.col("id").alias("node_b_id"), F.col("label").alias("b_label"), F.col("source").alias("b_source"))
    return top.join(a, "node_a_id").join(b, "node_b_id")


def resolve(candidates: DataFrame, candidate_id: str, merge: bool, by: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """The candidates with one decided, and its SAME_AS edge if merged. Raises KeyError if absent, ValueError if decided."""
    row = candidates.filter(F.col("id") == candidate_id).select("resolved").head(1)
    if not row:
        raise KeyError(candidate_id)
    if row[0][0] is not None:
        raise ValueError("already resolved")
    hit = F.col("id") == candidate_id
    out = candidates.withColumns({"resolved": F.when(hit, F.lit(merge)).otherwise(F.col("resolved")), "resolved_at": F.when(hit, now).otherwise(F.col("resolved_at")), "resolved_by": F.when(hit, F.lit(by)).otherwise(F.col("resolved_by"))})
    return out, same_as(candidates.filter(hit & F.lit(merge)), now)
