"""Building blocks that keep the operators balanced when one key holds a third
of the rows.

* ``join_dim`` broadcasts a side only after its size has been checked, and salts
  the join otherwise.
* ``draw_marks`` picks exactly n rows per class without ranking the class: a
  histogram of hash prefixes gives the prefix the cut falls into, and only the
  rows of that prefix are ranked.
* ``class_rank`` and ``with_position`` number rows with small windows plus
  offsets instead of one window over a class or over the table.
* ``tile_groups`` cuts big blocks into tiles, so that pairwise work in a block
  is spread over many bounded groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import shared_folder

DIM_ROWS = 100_000
DIM_BYTES = 64 * 1024 * 1024
SALTS = 64
HASH_PREFIX = 4  # hex digits: 65,536 even slices of the hash range


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores when the input has fewer splits than the cluster has cores.

    Large inputs have many splits already and pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores, *keys)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key once, so that later groupings below the key need no shuffle.

    The number of partitions is explicit: the rows are about to be multiplied
    and must not be merged into few partitions because they are still small.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * cores), *keys)


def bounded(df: DataFrame, max_rows: int = DIM_ROWS) -> DataFrame | None:
    """``df`` as a local relation if it has at most ``max_rows`` small rows, else None."""
    if max_rows <= 0:
        return None
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > DIM_BYTES:
        return None
    return df.sparkSession.createDataFrame(table, df.schema)


#: Rows with texts in an Arrow batch.
TEXT_ROWS = 1000


def small_text_batches(spark: SparkSession | None = None) -> None:
    """From now on texts go to Python in batches of TEXT_ROWS rows at most.

    Sets the session's size of Arrow batches, if it is larger: whole batches of
    long texts are in memory twice, in the JVM and in Python.
    """
    conf, name = (spark or SparkSession.active()).conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= TEXT_ROWS:
        conf.set(name, str(TEXT_ROWS))


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that it is made once and its lineage ends."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_dim(
    rows: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread_on: Sequence[str] | None = None,
    max_rows: int = DIM_ROWS,
) -> DataFrame:
    """Join a large table to a dimension that is usually small.

    The dimension is broadcast only when its size has been checked. Beyond the
    limit the join shuffles; with ``spread_on`` the rows of one key are salted
    over ``SALTS`` tasks so that a hot key does not end up in one of them.
    """
    on = list(on)
    small = bounded(dim, max_rows)
    if small is not None:
        return rows.join(F.broadcast(small), on, how)
    if spread_on is None:
        return rows.join(dim, on, how)
    salt = F.pmod(F.xxhash64(*spread_on), F.lit(SALTS))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    salted = rows.withColumn("_salt", salt)
    return salted.join(dim.withColumn("_salt", salts), [*on, "_salt"], how).drop("_salt")


def draw_key(key: str | Column, seed: int) -> Column:
    """The reproducible random key of a row: md5 of seed and row key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def draw_cutoffs(
    df: DataFrame, classes: Sequence[str], key: str, seed: int, want: DataFrame
) -> DataFrame:
    """The draw key of the ``want``-th row of every class, in draw order.

    ``want`` has the class columns and ``_want`` (bigint). Classes that want no
    row are absent from the result. Two narrow passes over key and class: a
    histogram with map-side counts, then a rank over one hash slice per class.
    """
    classes = list(classes)
    keyed = df.select(*classes, key, draw_key(key, seed).alias("_draw"))
    keyed = keyed.withColumn("_slice", F.substring("_draw", 1, HASH_PREFIX))
    slices = keyed.groupBy(*classes, "_slice").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*classes).orderBy("_slice"))
    total = F.sum("_n").over(W.partitionBy(*classes))
    counted = slices.withColumn("_upto", upto).withColumn("_total", total)
    edges = (
        counted.join(want, classes)  # both sides are counts, partitioned by class
        .withColumn("_want", F.least("_want", "_total"))
        .where((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .select(*classes, "_slice", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    edge_rows = join_dim(keyed, edges, [*classes, "_slice"], "inner")
    rank = F.row_number().over(W.partitionBy(*classes).orderBy("_draw", key))
    return (
        edge_rows.withColumn("_rank", rank)
        .where(F.col("_rank") == F.col("_left"))
        .select(*classes, F.col("_draw").alias("_cut"), F.col(key).alias("_cut_key"))
    )


def draw_marks(
    df: DataFrame,
    classes: Sequence[str],
    key: str,
    seed: int,
    want: DataFrame,
    mark: str = "_drawn",
) -> DataFrame:
    """Add a boolean column that is true for exactly ``_want`` rows per class.

    The wide rows are not shuffled: they meet one cutoff per class.
    """
    cuts = draw_cutoffs(df, classes, key, seed, want)
    drawn = draw_key(key, seed)
    before = (drawn < F.col("_cut")) | ((drawn == F.col("_cut")) & (F.col(key) <= F.col("_cut_key")))
    marked = join_dim(df, cuts, classes, "left", spread_on=[key])
    return marked.withColumn(mark, F.coalesce(before, F.lit(False))).drop("_cut", "_cut_key")


def class_rank(
    df: DataFrame, classes: Sequence[str], key: str, seed: int, rank: str = "_rank"
) -> DataFrame:
    """Add the 0-based rank of a row in its class, in draw order.

    The window runs inside one hash slice of a class; offsets of the slices come
    from their counts. Offsets and rows share one hash partitioning.
    """
    classes = list(classes)
    sliced = df.withColumn("_draw", draw_key(key, seed))
    sliced = sliced.withColumn("_slice", F.substring("_draw", 1, HASH_PREFIX))
    counts = sliced.groupBy(*classes, "_slice").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*classes).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *classes, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    inner = F.row_number().over(W.partitionBy(*classes, "_slice").orderBy("_draw", key)) - 1
    return (
        sliced.withColumn("_inner", inner)
        .join(offsets, [*classes, "_slice"])
        .withColumn(rank, F.col("_offset") + F.col("_inner"))
        .drop("_draw", "_slice", "_inner", "_offset")
    )


#: Keys in a range that is sorted and numbered on its own, about.
RANGE_ROWS = 1_000_000


def positions(keys: DataFrame, key: str, position: str = "_pos", slices: int | None = None) -> DataFrame:
    """(key, position): the 0-based place of each key in their order, null first; keys of any sortable type.

    Ranges of keys, as many as the rows call for, are sorted and numbered on
    their own and shifted by the counts of the ranges before them.
    """
    spark = keys.sparkSession
    ranges = slices or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // RANGE_ROWS))
    dealt = keys.select(key).repartitionByRange(ranges, key).sortWithinPartitions(key)
    dealt = kept(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "positions")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    shifts = counts.select("_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return dealt.join(F.broadcast(shifts), "_range").select(key, (F.col("_at") + F.col("_shift")).alias(position))


def by_own_key(df: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """``df`` with the other columns of ``made``, which has one row for each of its unique keys, null too."""
    made = made.withColumnRenamed(key, "_of")
    return df.join(made, df[key].eqNullSafe(made["_of"])).drop("_of")


def with_position(df: DataFrame, key: str, position: str = "_pos", slices: int | None = None) -> DataFrame:
    """Add the 0-based position of a row in the order of a unique key; only keys are sorted and numbered."""
    return by_own_key(df, positions(df.select(key), key, position, slices), key)


def tile_groups(df: DataFrame, block: Sequence[str], key: str, tile_rows: int, needs: Sequence[str] = (), main: str | None = None) -> DataFrame:
    """Spread the pairwise work of every block over bounded groups.

    A block of n rows becomes T = ceil(n / tile_rows) tiles. A row goes to every
    pair of tiles its own tile is part of, so any two rows of a block meet in
    exactly one group ``(block, _p, _q)`` of about two tiles. ``_t`` is the row's
    own tile. Blocks of one row have no pairs and are left out, and so are blocks in which
    no row has one of the marks that it ``needs``. Rows without the mark ``main`` are not sent to one
    another: the marked ones are the first tiles, and the others go to pairs with these only.
    """
    block = list(block)
    first = F.lit(True) if main is None else F.coalesce(main, F.lit(False))
    counts = [F.count("*").alias("_size"), F.count_if(first).alias("_mains")]
    sizes = df.groupBy(*block).agg(*counts, *[F.max(c).alias(f"_any{i}") for i, c in enumerate(needs)]).where("_size > 1 AND _mains > 0")
    for i in range(len(needs)):
        sizes = sizes.where(f"_any{i}").drop(f"_any{i}")
    tiles = lambda n: F.ceil(n / F.lit(tile_rows)).cast("long")
    tiled = (
        join_dim(df, sizes, block, "inner", spread_on=[key], max_rows=0)  # salted: a block may hold a third of the rows
        .withColumns({"_first": first, "_tiles": tiles(F.col("_mains")), "_others": tiles(F.col("_size") - F.col("_mains"))})
        .withColumn("_t", F.pmod(F.xxhash64(key), F.expr("if(_first, _tiles, _others)")) + F.expr("if(_first, 0, _tiles)"))
        .withColumn("_s", F.explode(F.expr("sequence(0L, if(_first, _tiles + _others, _tiles) - 1)")))
    )
    return (
        tiled.withColumn("_p", F.least("_t", "_s"))
        .withColumn("_q", F.greatest("_t", "_s"))
        .drop("_s", "_size", "_mains", "_first", "_tiles", "_others")
    )
