import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import ensembles as en
from quern.operators import metrics as me
from quern.operators import models as mo
from quern.operators import observations as ob
from quern.operators import recommend as re_
from quern.operators.features import bin_column, quantile_edges
from quern.operators.places import inside_pairs, near_counts, near_pairs
from quern.operators.positions import with_positions
from quern.scratch import cut
from quern.sources import files
from quern.streaming import events as ev


def test_positions_over_a_hot_group(spark):
    rows = [(None if i % 7 == 0 else ("hot" if i % 3 else f"g{i % 5}"), float(i % 11), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double, id int")
    got = {(r.g, r.id): r.p for r in with_positions(df, ["g"], [F.col("x").desc(), F.col("id").asc()], out="p", partitions=13).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))):
            want[g, r[2]] = i + 1
    assert got == want


def test_positions_weights_keep_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), ("a", 3, 1), ("b", 1, 2)], "g string, k int, w long")
    got = sorted(tuple(r) for r in with_positions(df, ["g"], [F.col("k").asc()], out="s", weight="w", partitions=5).select("g", "k", "s").collect())
    assert got == [("a", 1, 5), ("a", 2, 12), ("a", 3, 13), ("b", 1, 2)]
    assert with_positions(df, [], [F.col("k").asc()], keep=2).count() == 2
    assert with_positions(df.limit(0), ["g"], [F.col("k").asc()]).count() == 0
    with pytest.raises(ValueError):
        with_positions(df.select("g", "g"), ["g"], [])


def test_cut_keeps_clashing_names(spark):
    df = spark.createDataFrame([(1, 2)], "a int, A int")
    assert [tuple(r) for r in cut(df).collect()] == [(1, 2)]


def test_time_split_zero_and_errors(spark):
    df = spark.createDataFrame([(1, 5)], "id int, ts int")
    assert [r.part for r in ob.split_by_time(df, "ts", ratio=0.2).collect()] == ["train"]
    with pytest.raises(ValueError):
        ob.split_by_time(df, "ts")
    with pytest.raises(ValueError):
        ob.filter_interactions(df, df, "other")


def test_split_is_complete_and_disjoint(spark, sf):
    from quern.plans import views

    o = views.obs(spark, sf)
    parts = ob.hash_split(o, 0.2, ("userid", "itemid")).groupBy("part").count().collect()
    n = {r["part"]: r["count"] for r in parts}
    assert sum(n.values()) == o.count() and n["test"] == math.ceil(0.2 * o.count())


def test_metrics_by_hand(spark):
    test = spark.createDataFrame([("t", "u1", "a"), ("t", "u1", "b"), ("t", "u2", "c")], "dataset string, userid string, itemid string")
    recs = spark.createDataFrame([("u1", "a", 0), ("u1", "x", 1), ("u2", "x", 0)], "userid string, itemid string, rank long")
    m = {r.userid: r for r in me.user_metrics(test, recs, 6, 2).collect()}
    assert m["u1"].reciprocal == 1 and m["u1"].precision_at_k == 0.5 and m["u1"].recall_at_k == 0.5
    assert m["u1"].auc == 1 and m["u2"].auc == 0.5 and m["u2"].reciprocal == 0
    assert abs(m["u1"].n_dcg_at_k - 1 / (1 + 1 / math.log2(3))) < 1e-9
    assert me.coverage(test, recs, 2).first().n_coverage_at_k == pytest.approx(1 / 3)


def test_combiners_by_hand(spark):
    kind = "g string, i string, s double"
    a = spark.createDataFrame([("g", "x", 3.0), ("g", "y", 2.0), ("g", "z", 2.0)], kind)
    b = spark.createDataFrame([("g", "x", 1.0), ("g", "y", 9.0)], kind)
    get = lambda how: {r.i: r.s for r in en.combine_ranks([a, b], "g", "i", "s", 4.0, how).collect()}
    assert get("hmean") == pytest.approx({"x": 2 / 3, "y": 2 / 3.5, "z": 2 / 6.5})
    assert get("mean") == pytest.approx({"x": 0.75, "y": 0.7, "z": (0.4 + 0.25) / 2})
    assert get("min") == pytest.approx({"x": 0.5, "y": 0.4, "z": 0.25})
    assert get("max") == pytest.approx({"x": 1.0, "y": 1.0, "z": 0.4})
    assert get(np.mean) == pytest.approx(get("mean"))  # a reducer of blocks along an axis
    with pytest.raises(ValueError):
        get("median")


def test_recommendation_recovers_held_out_pairs(spark):
    from quern.operators.cooccurrence import top_cooccurring

    rows = [(f"u{u}", f"i{i}", 1.0) for u in range(4) for i in range(4) if u != i]
    o = spark.createDataFrame(rows, "userid string, itemid string, rating double")
    recs = re_.recommend(re_.item_scores(o, top_cooccurring(o, 10)), 10, exclude=o).collect()
    assert {(r.userid, r.itemid) for r in recs} == {(f"u{k}", f"i{k}") for k in range(4)}


def test_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "x double")
    edges = quantile_edges(df, "x", 4)
    assert len(edges) == 4
    bins = [r[0] for r in df.select(bin_column(F.col("x"), edges)).collect()]
    assert bins == sorted(bins) and set(bins) == {0, 1, 2}
    assert len(quantile_edges(df.withColumn("x", F.lit(1.0)), "x", 4)) == 5


def test_places(spark):
    rows = [("a", 0.0, 179.9999), ("b", 0.0, -179.9999), ("c", 0.0, 179.9999), ("c", 0.0, 179.9999), ("d", 89.99999, 10.0), ("e", 89.99999, -170.0), ("f", None, 1.0), ("g", float("nan"), 1.0), ("h", 0.0, 0.0), ("i", 91.0, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id string, lat double, long double")
    assert {tuple(r) for r in near_pairs(df, "id", 25.0).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("d", "e")}
    assert {r.id: r.neighbours for r in near_counts(df, "id", 25.0).collect()} == {"a": 2, "b": 2, "c": 2, "d": 1, "e": 1}
    assert near_pairs(df.limit(0), "id", 25.0).count() == 0
    ring = spark.createDataFrame([("r", 0, -1.0, 179.0), ("r", 1, -1.0, -179.0), ("r", 2, 1.0, -179.0), ("r", 3, 1.0, 179.0)], "region_id string, vertex_no int, lat double, long double")
    assert {r.id for r in inside_pairs(df, "id", ring).collect()} == {"a", "b", "c"}
    assert inside_pairs(df.limit(0), "id", ring).count() == 0


def test_many_places_at_one_spot(spark):
    df = spark.range(300).selectExpr("cast(id as string) id", "case when id < 200 then 10.0d else 10.0d + id / 10000 end lat", "20.0d long")
    got = {r.id: r.neighbours for r in near_counts(df, "id", 50.0).collect()}
    lat = [10.0 if i < 200 else 10.0 + i / 10000 for i in range(300)]
    step = math.radians(1) * 6_371_008.8
    assert got == {str(i): sum(abs(lat[i] - x) * step <= 50 for x in lat) - 1 for i in range(300)}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    files.write_csv(df, f"{tmp_path}/c")
    assert files.read_csv(spark, f"{tmp_path}/c", "k int, v string").count() == 2
    (tmp_path / "raw").write_text("1::a\n2::b\n")
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/raw", "k int, v string", "::", False).collect()] == [(1, "a"), (2, "b")]
    files.write_kv(df, f"{tmp_path}/kv", "t", "k")
    assert files.read_kv(spark, f"{tmp_path}/kv", ["t:k:1", "t:k:9"], "k int, v string").collect()[0].v == "x"
    calls = []
    make = lambda: (calls.append(1), df)[1]
    for _ in range(2):
        assert files.cached(spark, f"{tmp_path}/cache", make, "q").count() == 2
    assert len(calls) == 1


def test_stream_counts(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    for i in range(2):
        df.write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        ev.keep_counts(stream, ["k"], f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        assert {tuple(r) for r in ev.read_counts(spark, f"{tmp_path}/out", ["k"]).collect()} == {("a", 2 * (i + 1)), ("b", i + 1)}


def test_pairwise_ranking_learns(spark):
    rows = [(f"u{u}", f"i{i}", 1.0) for u in range(20) for i in range(10) if (u + i) % 2 == 0]
    o = spark.createDataFrame(rows, "userid string, itemid string, rating double")
    users, items = mo.bpr_factors(o, rank=4, epochs=8, rate=0.1)
    grid = o.select("userid").distinct().crossJoin(o.select("itemid").distinct())
    scored = re_.factor_scores(grid, users, items).join(o, ["userid", "itemid"], "left").groupBy(F.col("rating").isNotNull().alias("seen")).agg(F.avg("prediction").alias("p")).collect()
    p = {r.seen: r.p for r in scored}
    assert p[True] > p[False]


def test_search_and_early_stop():
    best, trail = mo.early_stop(lambda e: e, lambda e: -abs(e - 30) + 100, max_epochs=100, step_epochs=10, patience=20)
    assert best == 30 and trail[-1][0] <= 100
    report = mo.random_search({"a": [1, 2, 3]}, lambda t: 1 / t["a"], 10)
    assert report.target_loss.iloc[0] == report.target_loss.min() and "time_taken" in report


def test_positions_carry_timestamps_in_any_zone(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.sql("select timestamp'2020-01-01 00:00:00' t, 1 k union all select timestamp'2021-01-01 00:00:00', 2")
        got = [(r.k, str(r.t), r.p) for r in with_positions(df, [], [F.col("t").desc()], out="p").orderBy("p").selectExpr("k", "cast(t as string) t", "p").collect()]
        assert got == [(2, "2021-01-01 00:00:00", 1), (1, "2020-01-01 00:00:00", 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)
