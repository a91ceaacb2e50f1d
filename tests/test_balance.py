import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfwork.operators import balance as B
from shelfwork.operators import labels as N

SLOW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SIZES = st.lists(st.integers(1, 40), min_size=1, max_size=5)


def frame(spark, sizes):
    rows = [(c * 1000 + i, c) for c, n in enumerate(sizes) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, c int")


def counts(df):
    return {r["c"]: r["count"] for r in df.groupBy("c").count().collect()}


@SLOW
@given(SIZES)
def test_split_keeps_rows_and_proportions(spark, sizes):
    df = frame(spark, sizes)
    got = B.stratified_split(df, "c", "id").collect()
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in df.collect())
    total = sum(sizes)
    assert sum(r["split"] == "test" for r in got) == -(-total // 5)
    for c, n in enumerate(sizes):
        part = sum(r["split"] == "test" for r in got if r["c"] == c)
        assert abs(part - n * 0.2) <= 1.0


def test_nested_split_sizes(spark):
    got = B.nested_split(frame(spark, [100, 50]), "c", "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 96, "val": 24, "test": 30}


@SLOW
@given(SIZES)
def test_undersample_and_oversample(spark, sizes):
    df = frame(spark, sizes)
    assert set(counts(B.undersample(df, "c", "id")).values()) == {min(sizes)}
    over = B.oversample(df, "c", "id")
    assert set(counts(over).values()) == {max(sizes)}
    originals = over.where("copy = 0")
    assert originals.count() == sum(sizes) and originals.select("id").distinct().count() == sum(sizes)


def test_27_classes_times_3(spark):
    df = frame(spark, [3] + [18] * 26)
    assert B.undersample(df, "c", "id").count() == 81


@SLOW
@given(SIZES, st.integers(1, 200))
def test_resample_gives_exactly_n_rows(spark, sizes, n):
    df = frame(spark, sizes)
    w = B.class_weights(B.class_counts(df, "c"), "c", "sqrt", smoothing=0.3)
    assert B.weighted_resample(df, "c", "id", w, rows=n).count() == n


def test_many_copies_of_one_row(spark):
    df = frame(spark, [1, 25_000])
    got = B.oversample(df, "c", "id")
    assert counts(got) == {0: 25_000, 1: 25_000}
    assert got.where("c = 0").select("copy").distinct().count() == 25_000


def test_caps_and_quality(spark):
    df = frame(spark, [50, 10])
    assert counts(B.cap_classes(df, "c", "id", {0: 7})) == {0: 7, 1: 10}
    from pyspark.sql import functions as F

    rated = df.withColumn("q", (F.col("id") % 4).cast("int"))
    kept = B.drop_lowest(rated, "c", "id", "q", "0.5")
    assert counts(kept) == {0: 25, 1: 5}
    lost = rated.join(kept.select("id"), "id", "left_anti")
    for c in (0, 1):
        assert lost.where(f"c = {c}").agg(F.max("q")).first()[0] <= kept.where(f"c = {c}").agg(F.min("q")).first()[0]


def test_weights(spark):
    df = frame(spark, [10, 30])
    got = {r["c"]: r["weight"] for r in B.class_weights(B.class_counts(df, "c"), "c").collect()}
    assert got == pytest.approx({0: 2.0, 1: 40 / 60})
    eff = B.class_weights(B.class_counts(df, "c"), "c", "effective").collect()
    assert sum(r["weight"] for r in eff) == pytest.approx(2.0)
    with pytest.raises(ValueError):
        B.class_weights(B.class_counts(df, "c"), "c", "other")


def test_nearest_in_class_over_tiles(spark):
    rnd = np.random.default_rng(0)
    rows = [(i, i % 2, rnd.normal(size=4).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "id bigint, c int, v array<double>")
    got = {r["id"]: [x["neighbour"] for x in r["nearest"]] for r in B.nearest_in_class(df, "c", "id", "v", 3, tile_rows=9).collect()}
    for i, c, v in rows:
        others = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, d, w in rows if d == c and j != i)
        assert got[i] == [j for _, j in others[:3]]


def test_smote(spark):
    rows = [(i, int(i >= 4), [float(i), float(i * i % 7)]) for i in range(20)]
    df = spark.createDataFrame(rows, "id bigint, c int, v array<double>")
    got = B.smote(df, "c", "id", "v")
    assert counts(got) == {0: 16, 1: 16}
    with pytest.raises(ValueError):
        B.smote(df.selectExpr("id", "c", "'x' AS v"), "c", "id", "v")


def test_unknown_method_changes_nothing(spark):
    df = frame(spark, [3, 5])
    assert B.balance(df, "unknown", "c", "id").count() == 8
    assert B.balance(df, "undersample", "c", "id").count() == 6


def test_label_orders(spark):
    df = spark.createDataFrame([(c,) for c in (10, 40, 1140, 60)], "code int")
    got = {r["code"]: (r["numeric_id"], r["text_id"]) for r in N.between_orders(df, "code").collect()}
    assert got == {10: (0, 0), 40: (1, 2), 60: (2, 3), 1140: (3, 1)}


@pytest.mark.parametrize(("pivots", "spread"), [(12, 0.1), (5, 2.0)])
def test_nearest_in_class_over_cells(spark, pivots, spread):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(8, 5)) * 3
    rows = [(i, int(i % 7 == 0), (centres[i % 8] + spread * rnd.normal(size=5)).tolist()) for i in range(240)]
    rows += [(500 + i, 0, rows[1][2]) for i in range(6)] + [(600, 2, [0.0] * 5), (601, 3, [1.0] * 5), (602, 3, [2.0] * 5), (603, 0, None), (604, 0, [float("nan")] * 5)]
    df = spark.createDataFrame(rows, "id bigint, c int, v array<double>")
    got = {r["id"]: [x["neighbour"] for x in r["nearest"]] for r in B.nearest_in_class(df, "c", "id", "v", 3, tile_rows=20, pivots=pivots).collect()}
    good = [r for r in rows if r[2] and not np.isnan(r[2]).any()]
    want = {}
    for i, c, v in good:
        others = sorted((((np.array(w) - np.array(v)) ** 2).sum(), j) for j, d, w in good if d == c and j != i)
        if others:
            want[i] = [j for _, j in others[:3]]
    assert got == want


def test_nearest_in_an_empty_table(spark):
    assert B.nearest_in_class(spark.createDataFrame([], "id bigint, c int, v array<double>"), "c", "id", "v").collect() == []
