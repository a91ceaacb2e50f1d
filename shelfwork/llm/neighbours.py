"""Approximate nearest neighbours on shifted space-filling curves.

Vectors are projected, shifted and ordered along several Hilbert curves, each sort
being a range partitioning in Spark; an order is cut into blocks of equal size. A
query meets the blocks around its own on every curve, the finds merge and are
ranked by exact inner products. How many blocks on either side is measured: the
exact neighbours of a bounded sample of the queries show which width reaches the
recall asked for. Where the curves would read as much as one pass over all blocks
(in data without structure), the queries meet all blocks of one curve instead, in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import hash_sample, query, stored, table

CURVES, PROJECTED, DEPTH = 4, 8, 7
#: Blocks that a curve is cut into, of so many vectors at least and at most; vectors read at once in a pass over all of them.
BLOCKS, LEAST, MOST, READ = 128, 32, 4096, 4096
#: Queries in a tile; queries that the width is measured on; rows that the scale is fitted on.
TILE, MEASURED, FITTED = 2048, 64, 10_000
RECALL = 0.95
#: Inner products closer than this (of unit length) may be in another order until they are summed in one order.
MARGIN = 1e-9


@dataclass
class Curves:
    """Fixed projections of all curves, and the range of projected values on a sample."""

    axes: np.ndarray  # curve x dimension x projected
    low: np.ndarray  # curve x projected
    high: np.ndarray
    shift: np.ndarray

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        x = (vectors @ self.axes[curve] - self.low[curve]) / np.maximum(self.high[curve] - self.low[curve], 1e-300)
        cells = (np.clip(x, 0, 1) + self.shift[curve]) * 0.5 * ((1 << DEPTH) - 1)
        return hilbert(cells.astype(np.int64), DEPTH)


def hilbert(cells: np.ndarray, depth: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows of coordinates below 2**depth), by Skilling's transposition."""
    x, n = cells.T.copy(), cells.shape[1]
    bit = 1 << (depth - 1)
    q = bit
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = bit
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(depth - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def matrix(column) -> np.ndarray:
    """Rows of numbers as doubles, from an Arrow list column or a pandas column of arrays."""
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part, repeated ones once.

    Out are null ids, null, empty and zero vectors, vectors with null or
    non-finite components, and vectors not of the most frequent length.
    """
    v = F.col("vector")
    good = rows.select(F.col(key).alias("id"), F.col(vector).alias("vector")).filter(
        F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    length = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.filter(F.size("vector") == (length["n"] if length else 0)).distinct()


def fitted(vectors: DataFrame, curves: int, projected: int) -> Curves:
    sample = matrix(hash_sample(vectors, "class", FITTED).toPandas()["vector"])  # a bounded number of rows
    projected = min(projected, sample.shape[1])
    axes = np.stack([np.linalg.qr(np.random.default_rng(c).normal(size=(sample.shape[1], projected)))[0] for c in range(curves)])
    x = np.einsum("nd,cdp->cnp", sample, axes)
    shift = np.stack([np.random.default_rng(100 + c).uniform(0, 1, projected) for c in range(curves)])
    return Curves(axes, np.quantile(x, 0.001, axis=1), np.quantile(x, 0.999, axis=1), shift)


def placed(vectors: DataFrame, how: Curves, block: int) -> tuple[DataFrame, int]:
    """(curve, class, block) along every curve, blocks of equal size numbered in order; and how many there are."""
    n = len(how.axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            for c in range(n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), c, np.int32)), pa.array(how.keys(x, c) if len(x) else np.zeros(0, np.int64)), batch.column(0)],
                    ["curve", "key", "class"],
                )

    kind = vectors.schema["class"].dataType.simpleString()
    keys = vectors.select("class", "vector").mapInArrow(run, f"curve int, key long, class {kind}")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = keys.repartitionByRange(parts, "curve", "key", "class").sortWithinPartitions("curve", "key", "class")
    order = stored(order.select("curve", "class", F.monotonically_increasing_id().alias("at")), "curve-order")
    part = F.shiftright("at", 33)
    pieces = order.groupBy("curve", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    own = W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(own), F.lit(0)))  # as many rows as partitions and curves
    rows = order.withColumn("part", part).join(F.broadcast(pieces.drop("n")), ["curve", "part"])
    rows = rows.select("curve", "class", ((F.col("at") - F.col("first") + F.col("before")) / block).cast("int").alias("block"))
    rows = stored(rows, "curve-blocks")
    return rows, (rows.agg(F.max("block")).first()[0] or 0) + 1


def best_of_blocks(vectors: DataFrame, asked: DataFrame, k: int, tile: int, queries: int) -> DataFrame:
    """(asking, class, score): the ``k`` best classes of each block of ``vectors`` (class, vector, at) for those ``asked`` (asking, query, at).

    ``queries`` may meet in a block at most; they come in tiles, each with a copy of the block.
    """
    tiles = max(1, -(-queries // tile))
    left = vectors.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    right = asked.withColumn("tile", F.pmod(F.xxhash64("asking"), F.lit(tiles)).cast("int"))

    def meet(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(wanted):
            return pd.DataFrame({"asking": [], "class": [], "score": []})
        x, q = matrix(rows["vector"]), matrix(wanted["query"])
        ids, asking = rows["class"].to_numpy(), wanted["asking"].to_numpy()
        out = []
        for i in range(0, len(q), 256):
            part = q[i : i + 256]
            rough = part @ x.T
            least = np.partition(rough, -min(k, len(x)), axis=1)[:, -min(k, len(x))]
            slack = MARGIN * np.linalg.norm(part, axis=1) * np.linalg.norm(x, axis=1).max()
            a, b = np.nonzero(rough >= (least - slack)[:, None])
            score = np.zeros(len(a))
            for d in range(x.shape[1]):  # in one order for all, so that equal vectors have equal scores
                score += part[a, d] * x[b, d]
            order = np.lexsort((ids[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            keep = rank < k
            out.append(pd.DataFrame({"asking": asking[i + a[keep]], "class": ids[b[keep]], "score": score[keep]}))
        return pd.concat(out)

    kind = vectors.schema["class"].dataType.simpleString()
    found = left.groupBy("at", "tile").cogroup(right.groupBy("at", "tile")).applyInPandas(
        meet, f"asking {kind}, class {kind}, score double"
    )
    return best(found.distinct(), k)


def best(found: DataFrame, k: int, by: str = "asking", of: str = "class") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), of))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(
    rows: DataFrame, asks, k: int, key: str = "vec_id", vector: str = "embedding", curves: int = CURVES, projected: int = PROJECTED,
    block: int | None = None, tile: int = TILE, recall: float = RECALL, facts: dict | None = None,
) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``asks`` (a condition on ``id``) its ``k`` rows of largest inner product.

    Equal vectors are one class that is searched once and holds its k + 1 smallest
    ids: more can be in no answer, as ties go to the smaller id. Rows that take no
    part neither ask nor answer. Rows that share an id with the query count as its
    own; if they have several vectors, each asks and the answers are merged. With
    fewer candidates than ``k`` all are returned, an empty table gives no rows.
    Other columns are not looked at. ``block`` is by default what cuts a curve into
    BLOCKS, at every size; ``facts`` receives what was measured.
    """
    facts = {} if facts is None else facts
    good = usable(rows, key, vector)
    within = W.partitionBy("vector").orderBy("id")
    members = stored(
        good.withColumn("n", F.row_number().over(within)).filter(F.col("n") <= k + 1), "members"
    )
    heads = stored(members.filter("n = 1").select(F.col("id").alias("class"), "vector"), "classes")
    answer = f"query_id {good.schema['id'].dataType.simpleString()}, rank int, id {good.schema['id'].dataType.simpleString()}, score double"
    if heads.isEmpty():
        return rows.sparkSession.createDataFrame([], answer)
    # Ids may be shared, so classes are known by numbers, in the order of their smallest ids: that settles ties.
    numbered = stored(heads.orderBy("class").select(F.monotonically_increasing_id().alias("class"), "vector"), "numbered")
    members = stored(members.join(numbered, "vector").select("class", "id"), "members-of-classes")
    asking = stored(good.filter(asks).join(numbered, "vector").select(F.col("id").alias("query_id"), F.col("class").alias("asking")), "asking")
    asked = stored(numbered.join(asking.select(F.col("asking").alias("class")).distinct(), "class", "left_semi").select(
        F.col("class").alias("asking"), F.col("vector").alias("query")
    ), "asked")
    count, wanted = numbered.count(), asked.count()
    block = block or min(max(count // BLOCKS, LEAST), MOST)
    places, blocks = placed(numbered, fitted(numbered, curves, projected), block)

    # the exact neighbours of some queries, and how far from them they lie on each curve
    some = stored(hash_sample(asked, "asking", MEASURED, "measured"), "measured")
    joint = max(1, READ // block)  # neighbouring blocks are one in a pass over all of them
    first = places.filter("curve = 0").select("class", F.floor(F.col("block") / joint).cast("int").alias("at"))
    everywhere = lambda q: q.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit((blocks - 1) // joint))))
    truth = best_of_blocks(numbered.join(first, "class"), everywhere(some), k + 1, tile, MEASURED)
    apart = (
        truth.join(places, "class").withColumnRenamed("block", "own")
        .join(places.select("curve", F.col("class").alias("asking"), "block"), ["curve", "asking"])
        .groupBy("asking", "class").agg(F.min(F.abs(F.col("own") - F.col("block"))).alias("apart"))
    )
    apart = sorted(r["apart"] for r in apart.select("apart").collect())  # at most MEASURED times k + 1 numbers
    width = apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))))] if apart else 0
    scan = curves * (2 * width + 1) >= blocks
    facts.update(classes=count, queries=wanted, blocks=blocks, width=width, scan=scan)

    if scan:
        found = best_of_blocks(numbered.join(first, "class"), everywhere(asked), k + 1, tile, wanted)
    else:
        at = (F.col("block") * curves + F.col("curve")).alias("at")
        near = F.explode(F.sequence(F.greatest(F.col("block") - width, F.lit(0)), F.least(F.col("block") + width, F.lit(blocks - 1))))
        around = asked.join(places.withColumnRenamed("class", "asking"), "asking").select("asking", "query", "curve", near.alias("block"))
        found = best_of_blocks(
            numbered.join(places, "class").select("class", "vector", at), around.select("asking", "query", at), k + 1, tile,
            min(wanted, (2 * width + 1) * block),
        )
    # classes become rows again: k + 1 for each asking class, of which a query drops its own
    found = best(found.drop("rank").join(members, "class").select("asking", "id", "score"), k + 1, "asking", "id").drop("rank")
    out = found.join(asking, "asking").filter("id != query_id").select("query_id", "id", "score").groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return best(out, k, "query_id", "id").select("query_id", "rank", "id", "score")


@query("op2_neighbours")
def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows of every twentieth embedding."""
    out = nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, 20)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
