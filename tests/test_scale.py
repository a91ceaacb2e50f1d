from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfwork import scale


@pytest.fixture(scope="module")
def rows(spark):
    # one class holds most rows
    data = [(i, "hot" if i % 10 else f"c{i % 3}") for i in range(3000)]
    return spark.createDataFrame(data, "id bigint, c string")


def test_salted_join_equals_broadcast_join(spark, rows):
    dim = spark.createDataFrame([("hot", 1), ("c0", 2), ("c9", 3)], "c string, v int")
    small = scale.join_dim(rows, dim, ["c"], "left", spread_on=["id"])
    salted = scale.join_dim(rows, dim, ["c"], "left", spread_on=["id"], max_rows=0)
    plain = scale.join_dim(rows, dim, ["c"], "left", max_rows=0)
    want = sorted(map(tuple, small.select("id", "c", "v").collect()), key=str)
    assert sorted(map(tuple, salted.select("id", "c", "v").collect()), key=str) == want
    assert sorted(map(tuple, plain.select("id", "c", "v").collect()), key=str) == want
    assert "_salt" not in salted.columns


def test_bounded_refuses_large_sides(rows):
    assert scale.bounded(rows, 100) is None
    assert scale.bounded(rows.limit(100), 100).count() == 100


def test_draw_marks_counts(spark, rows):
    want = spark.createDataFrame([("hot", 500), ("c0", 10_000), ("c1", 0)], "c string, _want bigint")
    got = scale.draw_marks(rows, ["c"], "id", 42, want).where("_drawn").groupBy("c").count().collect()
    counts = {r["c"]: r["count"] for r in got}
    assert counts == {"hot": 500, "c0": 100}


def test_class_rank_is_dense(rows):
    got = scale.class_rank(rows, ["c"], "id", 1).select("id", "c", "_rank", scale.draw_key("id", 1).alias("d")).collect()
    for c in {r["c"] for r in got}:
        mine = sorted((r for r in got if r["c"] == c), key=lambda r: r["d"])
        assert [r["_rank"] for r in mine] == list(range(len(mine)))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(-(2**62), 2**62), min_size=1, max_size=300))
def test_with_position(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    got = {r["k"]: r["_pos"] for r in scale.with_position(df, "k", slices=8).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_positions_of_text_keys(spark):
    names = [f"ключ {i * 37 % 101}" for i in range(101)] + ["", None]
    got = {r["k"]: r["p"] for r in scale.with_position(spark.createDataFrame([(n, "x") for n in names], "k string, t string"), "k", "p", 7).collect()}
    assert got == {n: i for i, n in enumerate([None, *sorted(n for n in names if n is not None)])}


def test_every_pair_meets_once(spark):
    df = spark.createDataFrame([(i, i % 7 == 0) for i in range(140)], "id bigint, b boolean")
    groups = scale.tile_groups(df, ["b"], "id", 13).collect()
    meets = Counter()
    sizes = Counter()
    for r in groups:
        sizes[(r["b"], r["_p"], r["_q"])] += 1
    by_group = {}
    for r in groups:
        by_group.setdefault((r["b"], r["_p"], r["_q"]), []).append((r["id"], r["_t"]))
    for (_, p, q), members in by_group.items():
        left = [i for i, t in members if t == p]
        right = [i for i, t in members if t == q]
        for x in left:
            for y in right:
                if x != y and (p != q or x < y):
                    meets[frozenset((x, y))] += 1
    ids = {False: [i for i in range(140) if i % 7], True: [i for i in range(140) if i % 7 == 0]}
    want = {frozenset((x, y)) for part in ids.values() for x in part for y in part if x < y}
    assert set(meets) == want and set(meets.values()) == {1}
    assert max(sizes.values()) < 60


def test_rows_that_are_not_main_are_sent_to_main_ones_only(spark):
    df = spark.range(200).selectExpr("id", "id % 2 = 0 AS b", "id % 20 < 2 AS m")
    groups = scale.tile_groups(df, ["b"], "id", 10, ("m",), "m").collect()
    assert len(groups) < 20 * 12 + 180 * 3  # 10 tiles a block; before, each row went to all of them
    meets, by_group = Counter(), {}
    for r in groups:
        by_group.setdefault((r["b"], r["_p"], r["_q"]), []).append((r["id"], r["_t"]))
    for (_, p, q), members in by_group.items():
        left, right = ([i for i, t in members if t == tile] for tile in (p, q))
        meets.update(frozenset((x, y)) for x in left for y in right if x != y and (p != q or x < y))
    want = {frozenset((x, y)) for x in range(200) for y in range(x) if x % 2 == y % 2 and (x % 20 < 2 or y % 20 < 2)}
    assert set(meets) == want and set(meets.values()) == {1}


def test_single_rows_have_no_groups(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, b string")
    assert scale.tile_groups(df, ["b"], "id", 10).count() == 0


def test_spread_keeps_rows(rows):
    assert scale.spread(rows.select("id")).agg(F.count("*")).first()[0] == 3000
