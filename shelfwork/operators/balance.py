"""Splits, class balance and sampling.

Every random choice is an order by md5(seed | key), so runs repeat exactly.
Exact numbers per class come from one cutoff per class (``draw_marks``); wide
rows are neither ranked nor shuffled, and a class that holds a third of the rows
costs no more than a small one.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scale import class_rank, draw_key, draw_marks, join_dim
from .nearest import nearest_in_class

ALL = "_all"
COPIES_PER_ROW = 10_000


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def _whole(c):
    return c.cast("decimal(38,0)")


def shares_of_classes(counts: DataFrame, label: str, share: str | float) -> DataFrame:
    """How many rows of each class make up ``share`` of the table, by largest remainder."""
    everything = W.partitionBy()  # one row per class
    wanted = F.ceil(F.sum("n").over(everything) * F.lit(Decimal(str(share)))).cast("bigint")
    sized = counts.withColumn("_total", F.sum("n").over(everything)).withColumn("_take", wanted)
    product = _whole(F.col("n")) * _whole(F.col("_take"))
    sized = sized.withColumn("_base", F.floor(product / _whole(F.col("_total"))).cast("bigint"))
    remainder = product - _whole(F.col("_base")) * _whole(F.col("_total"))
    sized = sized.withColumn("_rest", remainder)
    left_over = F.col("_take") - F.sum("_base").over(everything)
    place = F.row_number().over(W.orderBy(F.desc("_rest"), label))
    extra = (place <= left_over).cast("bigint")
    return sized.select(label, (F.col("_base") + extra).alias("_want"))


def stratified_split(
    df: DataFrame, label: str, key: str, share: str | float = "0.2", seed: int = 42,
    names: tuple[str, str] = ("train", "test"), column: str = "split",
) -> DataFrame:
    """Mark ``share`` of the rows as the second part, in the same proportion per class."""
    want = shares_of_classes(class_counts(df, label), label, share)
    marked = draw_marks(df, [label], key, seed, want)
    part = F.when(F.col("_drawn"), F.lit(names[1])).otherwise(F.lit(names[0]))
    return marked.withColumn(column, part).drop("_drawn")


def nested_split(
    df: DataFrame, label: str, key: str, test: str = "0.2", val: str = "0.2",
    seeds: tuple[int, int] = (42, 43),
) -> DataFrame:
    """Train, validation and test: the validation part is drawn from the train part."""
    first = stratified_split(df, label, key, test, seeds[0])
    train = first.where("split = 'train'")
    want = shares_of_classes(class_counts(train, label), label, val)
    marked = draw_marks(first.withColumn("_train", F.col("split") == "train"), ["_train", label], key,
                        seeds[1], want.withColumn("_train", F.lit(True)))
    return marked.withColumn("split", F.when(F.col("_drawn"), "val").otherwise(F.col("split"))).drop("_drawn", "_train")


def random_split(df: DataFrame, key: str, share: str = "0.2", seed: int = 42) -> DataFrame:
    """Mark ``share`` of all rows as the second part."""
    return stratified_split(df.withColumn(ALL, F.lit(0)), ALL, key, share, seed).drop(ALL)


def undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest."""
    counts = class_counts(df, label)
    want = counts.select(label, F.min("n").over(W.partitionBy()).alias("_want"))
    return draw_marks(df, [label], key, seed, want).where("_drawn").drop("_drawn")


def samples_per_class(df: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """At most k random rows per class."""
    want = class_counts(df, label).select(label, F.lit(k).cast("bigint").alias("_want"))
    return draw_marks(df, [label], key, seed, want).where("_drawn").drop("_drawn")


def cap_classes(df: DataFrame, label: str, key: str, caps: dict, seed: int = 42) -> DataFrame:
    """Named classes keep at most their cap; the others stay whole."""
    named = df.where(F.col(label).isin(list(caps)))
    cap = F.coalesce(*[F.when(F.col(label) == c, F.lit(n)) for c, n in caps.items()]).cast("bigint")
    want = class_counts(named, label).select(label, cap.alias("_want"))
    marked = draw_marks(df, [label], key, seed, want)
    open_class = ~F.coalesce(F.col(label).isin(list(caps)), F.lit(False))
    return marked.where(F.col("_drawn") | open_class).drop("_drawn")


def random_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n random rows."""
    want = df.sparkSession.range(1).select(F.lit(0).alias(ALL), F.lit(n).cast("bigint").alias("_want"))
    marked = draw_marks(df.withColumn(ALL, F.lit(0)), [ALL], key, seed, want)
    return marked.where("_drawn").drop("_drawn", ALL)


def random_per_class(
    df: DataFrame, label: str, key: str, classes: int, rows: int = 1, seed: int = 42
) -> DataFrame:
    """``rows`` random rows of each of ``classes`` random classes."""
    known = class_counts(df, label).orderBy(draw_key(label, seed), label).limit(classes)
    want = known.select(label, F.lit(rows).cast("bigint").alias("_want"))
    return draw_marks(df, [label], key, seed, want).where("_drawn").drop("_drawn")


def repeat_rows(df: DataFrame, copies: str, number: str = "copy", key: str | None = None) -> DataFrame:
    """One row per copy, numbered from 0; rows with no copy go.

    A row with very many copies is first cut into lots that are spread over the
    cluster, so that no task writes all copies of one row.
    """
    lots = df.where(F.col(copies) > 0).withColumn(
        "_lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(copies) - 1) / COPIES_PER_ROW)))
    )
    if key is not None:
        lots = lots.repartition(F.col(key), F.col("_lot"))
    start = F.col("_lot") * COPIES_PER_ROW
    end = F.least(start + COPIES_PER_ROW, F.col(copies)) - 1
    return lots.withColumn(number, F.explode(F.sequence(start, end))).drop("_lot", copies)


def oversample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every class filled up to the size of the largest; originals are copy 0.

    The missing rows go round the class in draw order, so a row gets the whole
    rounds plus one if it comes early enough in the last, incomplete round.
    """
    everything = W.partitionBy()  # one row per class
    counts = class_counts(df, label).withColumn("_missing", F.max("n").over(everything) - F.col("n"))
    rounds = F.floor(F.col("_missing") / F.col("n")).cast("bigint")
    plan = counts.select(
        label, rounds.alias("_rounds"), (F.col("_missing") % F.col("n")).cast("bigint").alias("_want")
    )
    marked = draw_marks(df, [label], key, seed, plan.where("_want > 0").select(label, "_want"))
    sized = join_dim(marked, plan.select(label, "_rounds"), [label], "left", spread_on=[key])
    copies = F.lit(1).cast("bigint") + F.col("_rounds") + F.col("_drawn").cast("bigint")
    most = plan.agg(F.max("_rounds")).first()[0] or 0
    sized = sized.withColumn("_copies", copies).drop("_rounds", "_drawn")
    return repeat_rows(sized, "_copies", "copy", key if most > COPIES_PER_ROW else None)


# ---------------------------------------------------------------------- weights


def class_weights(
    counts: DataFrame, label: str, method: str = "balanced", beta: float = 0.999, smoothing: float = 0.0
) -> DataFrame:
    """One weight per class from its count ``n``.

    ``balanced``: N / (K n). ``effective``: by effective numbers, scaled to sum
    K. ``sqrt``: 1 / sqrt(n), zero for an empty class. Smoothing mixes in 1.
    """
    everything = W.partitionBy()  # one row per class
    n = F.col("n").cast("double")
    classes = F.count("*").over(everything)
    if method == "balanced":
        weight = F.sum("n").over(everything) / (classes * n)
    elif method == "effective":
        raw = F.lit(1.0 - beta) / (1.0 - F.pow(F.lit(beta), n))
        weight = raw / F.sum(raw).over(everything) * classes
    elif method == "sqrt":
        weight = F.when(n > 0, 1.0 / F.sqrt(n)).otherwise(0.0)
    else:
        raise ValueError(f"unknown method {method!r}")
    out = counts.select(label, "n", weight.alias("weight"))
    if smoothing:
        out = out.withColumn("weight", F.lit(1.0 - smoothing) * F.col("weight") + F.lit(smoothing))
    return out


def weight_range(weights: DataFrame) -> DataFrame:
    return weights.agg(
        F.min("weight").alias("smallest"), F.max("weight").alias("largest"),
        (F.max("weight") / F.min("weight")).alias("ratio"),
    )


def weighted_resample(
    df: DataFrame, label: str, key: str, weights: DataFrame, rows: int | None = None,
    seed: int = 42, offset: float = 0.5,
) -> DataFrame:
    """Systematic resample to ``rows`` rows with a chance proportional to the class weight.

    Rows lie side by side on a line, class after class, each as long as its
    weight; every unit mark on the line is one copy of the row it falls on.
    """
    mass = F.col("n") * F.col("weight")
    in_order = W.orderBy(label)  # one row per class
    upto = F.sum(mass).over(in_order.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum(mass).over(W.partitionBy())
    size = F.sum("n").over(W.partitionBy()) if rows is None else F.lit(rows)
    line = weights.select(
        label, "n", F.col("weight"), total.alias("_total"), size.alias("_rows"),
        upto.alias("_upto"), F.row_number().over(in_order).alias("_i"), F.count("*").over(W.partitionBy()).alias("_k"),
    )
    line = line.select(
        label,
        F.col("n").alias("_n"),
        F.col("_rows"),
        (F.col("weight") / F.col("_total")).alias("_step"),
        F.coalesce(F.lag("_upto").over(in_order) / F.col("_total"), F.lit(0.0)).alias("_from"),
        F.when(F.col("_i") == F.col("_k"), 1.0).otherwise(F.col("_upto") / F.col("_total")).alias("_to"),
    )
    ranked = join_dim(class_rank(df, [label], key, seed), line, [label], "inner", spread_on=[key])

    def marks(rank):
        place = F.when(rank == F.col("_n"), F.col("_to")).otherwise(F.col("_from") + F.col("_step") * rank)
        return F.floor(place * F.col("_rows") + F.lit(offset))

    copies = marks(F.col("_rank") + 1) - marks(F.col("_rank"))
    sized = ranked.withColumn("_copies", copies).drop("_n", "_rows", "_step", "_from", "_to", "_rank")
    return repeat_rows(sized, "_copies", "copy")


# ---------------------------------------------------------------------- quality


def drop_lowest(
    df: DataFrame, label: str, key: str, quality: str, share: str = "0.408", seed: int = 42
) -> DataFrame:
    """Drop the given share of rows with the lowest quality per class.

    ``quality`` is an integer. Counts per value give the value the cut falls
    into; rows of that value are cut in draw order.
    """
    values = df.groupBy(label, quality).agg(F.count("*").alias("_n"))
    in_class = W.partitionBy(label)
    counted = values.withColumn("_upto", F.sum("_n").over(in_class.orderBy(quality)))
    size = F.sum("_n").over(in_class)
    counted = counted.withColumn("_drop", F.floor(size * F.lit(Decimal(share))).cast("bigint"))
    edge = counted.where((F.col("_upto") > F.col("_drop")) & (F.col("_upto") - F.col("_n") <= F.col("_drop")))
    edge = edge.select(
        label, F.col(quality).alias("_edge"), (F.col("_drop") - F.col("_upto") + F.col("_n")).alias("_want")
    )
    placed = join_dim(df, edge.select(label, "_edge"), [label], "left", spread_on=[key])
    placed = placed.withColumn("_at_edge", F.col(quality) == F.col("_edge"))
    want = edge.where("_want > 0").select(label, F.lit(True).alias("_at_edge"), "_want")
    marked = draw_marks(placed, [label, "_at_edge"], key, seed, want)
    kept = (F.col(quality) > F.col("_edge")) | (F.col("_at_edge") & ~F.col("_drawn"))
    return marked.where(kept).drop("_edge", "_at_edge", "_drawn")


# ------------------------------------------------------------------------ SMOTE


def smote(
    df: DataFrame, label: str, key: str, vector: str, k: int = 3, seed: int = 42, tile_rows: int = 2000
) -> DataFrame:
    """Fill smaller classes with points between a row and one of its k nearest neighbours.

    Works on numeric vectors only. The result has the originals (copy 0) and the
    synthetic rows (copy 1, 2, ...) with the key of the row they start from.
    """
    kind = dict(df.dtypes)[vector]
    if not kind.startswith("array<"):
        raise ValueError(f"{vector} is {kind}, SMOTE needs an array of numbers")
    rows = df.select(label, key, F.col(vector).cast("array<double>").alias(vector))
    growing = class_counts(rows, label).withColumn("_top", F.max("n").over(W.partitionBy())).where("n < _top")
    growing_rows = join_dim(rows, growing.select(label), [label], "inner", spread_on=[key])
    near = nearest_in_class(growing_rows, label, key, vector, k, tile_rows)
    # a row meets its neighbours before it is copied: one row may have very many copies
    other = rows.select(F.col(key).alias("neighbour"), F.col(vector).alias("_other"))
    near = near.select(key, F.posexplode("nearest").alias("_i", "_near")).select(key, "_i", F.col("_near.neighbour").alias("neighbour"))
    near = near.join(other, "neighbour").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "neighbour", "_other"))).alias("_nearest"))
    synthetic = oversample(rows.join(near, key, "left"), label, key, seed).where("copy > 0")

    def draw(part):
        text = F.concat(F.lit(f"{seed}|{part}|"), F.col(key).cast("string"), F.lit("|"), F.col("copy").cast("string"))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")

    chosen = synthetic.withColumn("_chosen", F.get("_nearest", (draw("pick") % F.greatest(F.size("_nearest"), F.lit(1))).cast("int")))
    share = draw("share") / F.lit(float(2**32))
    moved = F.zip_with(vector, "_chosen._other", lambda a, b: a + F.col("_share") * (b - a))
    made = chosen.withColumn("neighbour", F.col("_chosen.neighbour")).withColumn("_share", share)
    made = made.withColumn(vector, F.coalesce(moved, F.col(vector)))
    originals = rows.withColumns({"copy": F.lit(0).cast("bigint"), "neighbour": F.lit(None).cast(dict(df.dtypes)[key])})
    cols = [key, label, "copy", "neighbour", vector]
    return originals.select(*cols).unionByName(made.select(*cols))


def balance(df: DataFrame, method: str, label: str, key: str, seed: int = 42, vector: str | None = None) -> DataFrame:
    """Balance by name: ``undersample``, ``oversample``, ``smote``; anything else changes nothing."""
    if method == "undersample":
        return undersample(df, label, key, seed)
    if method == "oversample":
        return oversample(df, label, key, seed)
    if method == "smote":
        if vector is None:
            raise ValueError("smote needs a vector column")
        return smote(df, label, key, vector, seed=seed)
    return df
