"""The exact nearest rows of the same class, by Euclidean distance.

Sampled vectors are pivots; a row lives in the cell of its nearest pivot. The
first round looks for neighbours in a row's own cell. Its k-th distance, or that to the
sampled rows if it is shorter, is a radius beyond which nothing matters. In the
second round a row visits only the cells that this radius reaches over the border: those whose
pivot is nearer than twice the radius beyond its own, and whose rows begin and
end within the radius. Crowded cells are cut into tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import kept, tile_groups
from .similar import spread_pivots

#: Vectors sampled and pivots at most; they and the radii of their cells go through the driver.
SAMPLE, PIVOTS = 1024, 256
#: Comparisons that cost as much as sending a row once more.
ROW = 1000
#: By how much distances to pivots may be off, relative to the largest.
SLACK = 1e-6


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (vectors * vectors).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def _reached(to_pivots: np.ndarray, radius: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Marks of the cells, other than a row's own, that may hold a row within its radius."""
    each, home = np.arange(len(to_pivots)), to_pivots.argmin(axis=1)
    own, far = to_pivots[each, home][:, None], radius[:, None] + SLACK * (1 + to_pivots.max(initial=0.0))
    goes = (to_pivots <= own + 2 * far) & (to_pivots <= most + far) & (to_pivots >= least - far)
    goes[each, home] = False
    return goes


def _kth(square: np.ndarray, k: int) -> np.ndarray:
    """The k-th smallest of each row; infinite in rows of fewer."""
    return np.sqrt(np.partition(square, k - 1, axis=1)[:, k - 1]) if square.shape[1] >= k else np.full(len(square), np.inf)


def _best_pivots(vectors: np.ndarray, classes: np.ndarray, n: int, k: int, tile_rows: int) -> np.ndarray:
    """The sampled vectors that make the search cost least; a single one if cells save nothing."""
    order = spread_pivots(vectors, PIVOTS, distances)
    to_all, scale = distances(vectors, vectors[order]), n / len(vectors)
    gaps = distances(vectors, vectors)
    gaps[(classes[:, None] != classes) | np.eye(len(vectors), dtype=bool)] = np.inf
    radius = _kth(gaps**2, k)
    costs, count = {}, 1
    while count <= len(order):
        to_pivots = to_all[:, :count]
        home = to_pivots.argmin(axis=1)
        least, most = np.full(count, np.inf), np.full(count, -np.inf)
        np.minimum.at(least, home, to_pivots.min(axis=1))
        np.maximum.at(most, home, to_pivots.min(axis=1))
        visits = _reached(to_pivots, radius, least, most).sum(axis=0) + np.bincount(home, minlength=count)
        members = np.bincount(home, minlength=count) * scale / max(len(np.unique(classes)), 1)
        visits = visits * scale
        costs[count] = (visits * members).sum() + ROW * (visits * np.ceil(2 * members / tile_rows)).sum()
        count *= 2
    return vectors[order[: min(costs, key=costs.get)]]


def _of(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _candidates(key: str, k: int):
    """For each row that asks in two tiles of a cell, its k nearest members there."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        p, q = group["_p"].iloc[0], group["_q"].iloc[0]
        out = []

        def meet(asking: pd.DataFrame, members: pd.DataFrame) -> None:
            if not len(asking) or not len(members):
                return
            x, y = (np.array(part["_v"].tolist()).reshape(len(part), -1) for part in (asking, members))
            keys = members[key].to_numpy()
            for own, vector, radius in zip(asking[key], x, asking["_radius"], strict=True):
                gaps = ((y - vector) ** 2).sum(axis=1)
                near = np.flatnonzero((gaps <= radius * radius) & (keys != own))
                for j in near[np.lexsort((keys[near], gaps[near]))][:k]:
                    out.append((own, keys[j], float(gaps[j])))

        left, right = group[group["_t"] == p], group[group["_t"] == q]
        for asking, members in ((left, right), (right, left)) if p != q else ((left, left),):
            meet(asking[asking["_asks"]], members[members["_lives"]])
        return pd.DataFrame(out, columns=[key, "neighbour", "gap"])

    return run


def _merged(found: DataFrame, key: str, k: int) -> DataFrame:
    """The k smallest (gap, neighbour) of each row."""
    nearest = F.slice(F.sort_array(F.collect_list(F.struct("gap", "neighbour"))), 1, k)
    return found.groupBy(key).agg(nearest.alias("nearest"))


def nearest_in_class(
    df: DataFrame, label: str, key: str, vector: str, k: int = 3, tile_rows: int = 2000, pivots: int | None = None
) -> DataFrame:
    """(key, nearest): the k nearest other rows of the same class as (gap, neighbour), gap the squared distance; ties to the smaller key.

    Exact. Rows without a label, a key or finite numbers neither ask nor answer;
    a row alone in its class is left out. ``pivots`` sets their number; without it
    a sample tells which number costs least.
    """
    kind = dict(df.dtypes)[key]
    numbers = df.select(F.col(label).alias("_label"), key, F.col(vector).cast("array<double>").alias("_v")).dropna()
    numbers = numbers.where(F.forall("_v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    hashed = F.pmod(F.xxhash64(F.lit("pivot"), F.col(key)), F.lit(1 << 31))
    n = numbers.count()
    some = numbers.where(hashed <= int((1 << 31) * min(1.0, 2 * SAMPLE / max(n, 1)))).orderBy(hashed, key).limit(SAMPLE)
    rows = some.select(F.xxhash64("_label").alias("class"), key, "_v").collect() or numbers.select(F.xxhash64("_label").alias("class"), key, "_v").limit(1).collect()
    schema = f"{key} {kind}, neighbour {kind}, gap double"
    if not rows:
        return _merged(df.sparkSession.createDataFrame([], schema), key, k)
    sample, classes = np.array([r["_v"] for r in rows]), np.array([r["class"] for r in rows])
    if pivots is None and n <= tile_rows:
        chosen = sample[:1]  # all rows fit in one tile
    elif pivots is None:
        chosen = _best_pivots(sample, classes, n, k, tile_rows)
    else:
        chosen = sample[spread_pivots(sample, pivots, distances)]
    shared = df.sparkSession.sparkContext.broadcast((sample, classes, np.array([r[key] for r in rows], dtype=object), chosen))

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_class, known_key, own_pivots = shared.value
        for batch in batches:
            v = _of(batch.column(3), len(batch))
            to_pivots = distances(v, own_pivots)
            square = distances(v, known) ** 2
            square[batch.column(1).to_numpy()[:, None] != known_class] = np.inf
            square[np.array(batch.column(2).to_pylist(), dtype=object)[:, None] == known_key] = np.inf
            radius = _kth(square, k) + SLACK * (1 + np.sqrt((v * v).sum(axis=1)))
            arrays = [*batch.columns, pa.array(to_pivots.argmin(axis=1)), pa.array(to_pivots.min(axis=1)), pa.array(radius)]
            yield pa.RecordBatch.from_arrays(arrays, ["_label", "_class", key, "_v", "_cell", "_far", "_radius"])

    named = numbers.select("_label", F.xxhash64("_label").alias("_class"), key, "_v")
    lived = named.select("*").schema.add("_cell", "long").add("_far", "double").add("_radius", "double")
    at_home = kept(named.mapInArrow(homes, lived), "cells").drop("_class")
    asking = at_home.select("_label", "_cell", key, "_v", "_radius", F.lit(True).alias("_asks"), F.lit(True).alias("_lives"))
    places = ["_label", "_cell"]

    def search(rows: DataFrame) -> DataFrame:
        return tile_groups(rows, places, key, tile_rows, ("_asks", "_lives")).groupBy(*places, "_p", "_q").applyInPandas(_candidates(key, k), schema)

    first = kept(search(asking), "nearest")
    if len(chosen) == 1:
        return _merged(first, key, k)
    reach = _merged(first, key, k).where(F.size("nearest") == k).select(key, (F.sqrt(F.element_at("nearest", -1)["gap"]) * (1 + SLACK)).alias("_reach"))
    radii = at_home.groupBy("_cell").agg(F.min("_far"), F.max("_far")).collect()  # a row for each pivot
    least, most = np.full(len(chosen), np.inf), np.full(len(chosen), -np.inf)
    for cell, low, high in radii:
        least[cell], most[cell] = low, high

    def leaving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_pivots = shared.value[3]
        for batch in batches:
            goes = _reached(distances(_of(batch.column(2), len(batch)), own_pivots), batch.column(3).to_numpy(), least, most)
            row, cell = np.nonzero(goes)
            label, own, v, radius = (c.take(pa.array(row)) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([label, pa.array(cell), own, v, radius], ["_label", "_cell", key, "_v", "_radius"])

    bounded = at_home.join(reach, key, "left").select("_label", key, "_v", F.least("_radius", F.coalesce("_reach", F.lit(float("inf")))).alias("_radius"))
    visits = bounded.mapInArrow(leaving, asking.select(*places, key, "_v", "_radius").schema)
    visits = visits.withColumns({"_asks": F.lit(True), "_lives": F.lit(False)})
    second = search(visits.unionByName(asking.withColumn("_asks", F.lit(False))))
    return _merged(first.unionByName(second), key, k)
