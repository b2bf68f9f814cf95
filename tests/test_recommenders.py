import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import ensembles as en
from quern.operators import features as fe
from quern.operators import models as mo
from quern.operators import observations as ob
from quern.operators import recommenders as rc
from quern.operators import similarity as si
from quern.sources import files
from quern.scratch import fits_broadcast

KIND = "userid string, itemid string, rating double"


@pytest.fixture(scope="module")
def held(spark):
    """Everyone has all items of an own half but the one of the own number."""
    rows = [(f"u{u}", f"i{i}", 1.0) for u in range(12) for i in range(12) if i != u and i % 2 == u % 2]
    return spark.createDataFrame(rows, KIND)


def first(df):
    return {r.userid: r.itemid for r in df.collect()}


def test_fitted_recommenders_find_the_missing_item(spark, held):
    want = {f"u{u}": f"i{u}" for u in range(12)}
    item = rc.ItemCooccurrence().fit(held)
    assert first(item.recommend(n=1)) == want
    assert first(rc.UserCooccurrence().fit(held).recommend(n=1)) == want
    both = rc.RankEnsemble([rc.ItemCooccurrence(), rc.UserCooccurrence()]).fit(held)
    assert first(both.recommend(n=1)) == want
    seen = item.recommend(users=["u0", "nobody"], n=3, exclusions=False).collect()
    assert len(seen) == 3 and {r.userid for r in seen} == {"u0"}
    assert item.recommend(items=["i1"], users=["u1"], n=5).count() == 1
    lists = item.lists(n=2, users=["u1"]).first()
    assert lists.itemid[0] == "i1"


def test_parameters_exclusions_and_clones(spark, held):
    rec = rc.ItemCooccurrence(degree=2, prune_ratio=0.5)
    with pytest.raises(ValueError):
        rec.set_params(unknown=1)
    rec.fit(held)
    other = rec.clone()
    assert other.get_params() == rec.get_params() and other.train is None
    with pytest.raises(ValueError):
        rec.set_excluded(None, False)
    rec.set_excluded(spark.createDataFrame([("u0", "i0", 1.0)], KIND))
    assert "i0" not in {r.itemid for r in rec.recommend(users=["u0"], n=12).collect()}


def test_evaluation_of_several_sets(spark, held):
    rec = rc.ItemCooccurrence().fit(held)
    test = spark.createDataFrame([(f"u{u}", f"i{u}", 1.0) for u in range(6)] + [("nobody", "i1", 1.0)], KIND)
    rows = {r.dataset: r for r in rec.evaluate({"a ": test, "b ": test.limit(2)}, k=2).collect()}
    assert set(rows) == {"train", "a test", "b test"}
    assert rows["a test"].recall_at_k == 1 and rows["a test"].reciprocal == 1 and rows["train"].auc > 0.5
    exact = rec.evaluate({"": test}, k=2, n=None, include_train=False).first()
    assert exact.recall_at_k == 1


def test_serving_agrees_with_the_tables(spark, held):
    rec = rc.ItemCooccurrence().fit(held)
    got = rec.predict_for_user("u1", ["i1", "i3", "i0", "unknown"])
    assert got.itemid.iloc[0] == "i1" and np.isneginf(got.prediction[got.itemid.isin(["i3", "unknown"])]).all()
    score = rec.recommend(users=["u1"], n=1).first().prediction
    assert got.prediction.iloc[0] == pytest.approx(score, abs=1e-6)
    assert np.isneginf(rec.predict_for_user("nobody", ["i1"]).prediction).all()
    order = rec.predict_for_user("u1", ["i0", "i1"], combine_order=True)
    assert set(order.prediction) == {1.5}
    both = rc.RankEnsemble([rec, rc.ItemCooccurrence().fit(held)])
    assert both.predict_for_user("u1", ["i1", "i3", "i0"]).itemid.iloc[0] == "i1"


def test_similarity_tables_add_up_and_combine(spark, held):
    table = spark.createDataFrame([("i0", "i2", 0.5), ("i2", "i4", 0.2)], "itemid_source string, itemid string, prediction double")
    rec = rc.SimilarityTable().fit_table(held, table).extend(table)
    sims = {(r.itemid_source, r.itemid): r.prediction for r in rec.similar(n=5).collect()}
    assert sims == {("i0", "i2"): 1.0, ("i2", "i0"): 1.0, ("i2", "i4"): 0.4, ("i4", "i2"): 0.4}
    seen = []
    ens = rc.SimilarityEnsemble([rc.ItemCooccurrence(), rc.ItemCooccurrence()], sink=seen.append, blocks=2, n_unfiltered=5).fit(held)
    assert len(seen) == 3 and seen[-1] is None
    assert first(ens.recommend(n=1))["u3"] == "i3"


def test_cells_and_cascade(spark, held):
    places = spark.createDataFrame([(f"i{i}", float(i % 2), float(i)) for i in range(12)], "itemid string, lat double, long double")
    cells = rc.SubdivisionEnsemble(rc.ItemCooccurrence, places, n_lat=2, n_long=1, margin=0.1).fit(held)
    assert len(cells.members) == 2 and first(cells.recommend(n=1))["u5"] == "i5"
    cascade = rc.CascadeEnsemble([rc.ItemCooccurrence(), rc.SimilarityTable()])
    cascade.members[1].table = rc.ItemCooccurrence().fit(held).sim
    assert first(cascade.fit(held).recommend(n=1))["u2"] == "i2"


@pytest.mark.parametrize("loss", ["warp", "hinge"])
def test_ranking_losses_and_batches(spark, held, loss):
    rec = rc.RankingRecommender(rank=6, epochs=6, rate=0.1, loss=loss).fit(held)
    grid = held.select("userid").distinct().crossJoin(held.select("itemid").distinct())
    p = rec.predict(grid).join(held, ["userid", "itemid"], "left").groupBy(F.col("rating").isNotNull().alias("seen")).agg(F.avg("prediction").alias("p"))
    p = {r.seen: r.p for r in p.collect()}
    assert p[True] > p[False]
    if loss == "warp":
        more = rec.fit_batches([held.filter("itemid < 'i5'"), held.filter("itemid >= 'i5'")])
        assert more.item_factors.count() == 12 and more.similar(n=2).count() == 24
        with pytest.raises(ValueError):
            rc.RankingRecommender(loss="other").fit(held)


def test_voting_and_search(spark):
    df = spark.createDataFrame([(i % 2, 0.9 if i % 2 else 0.1, 0.5, 0.1 if i % 2 else 0.9) for i in range(40)], "label int, good double, flat double, bad double")
    weights = rc.voting_weights(df, "label", ["good", "flat", "bad"], cutoff=1.0)
    assert set(weights) == {"good"}
    assert rc.soft_votes(df, ["good", "flat"], [1, 1]).filter("label = 1").first().probability == pytest.approx(0.7)
    report = mo.guided_search(spark, {"a": [1, 2, 3, 4]}, lambda t: abs(t["a"] - 3), 6, random_share=0.8)
    assert len(report) == 6 and report.target_loss.iloc[0] == report.target_loss.min()


def test_chance_and_best_ranks(spark):
    test = spark.createDataFrame([("u", f"i{i}") for i in range(7)] + [("v", "i1")], "userid string, itemid string")
    assert sorted(r["rank"] for r in mo.best_ranks(test).filter("userid = 'u'").collect()) == list(range(7))
    drawn = [r["rank"] for r in mo.chance_ranks(test, 10).filter("userid = 'u'").collect()]
    assert len(set(drawn)) == 7 and 0 <= min(drawn) and max(drawn) < 10


def test_featuriser_and_roles(spark):
    rows = [(f"i{i}", "ab"[i % 2], float(i), i % 2) for i in range(40)] + [("n", None, None, None)]
    df = spark.createDataFrame(rows, "itemid string, kind string, size double, flag int")
    for mode in ("binarise", "numeric", "gray"):
        f = fe.Featuriser(n_bins=4, mode=mode, weights={"kind": 2.0}, n_unique=10).fit(df)
        out = f.transform(df.limit(5), identity=True, normalise=mode == "binarise")
        assert out.filter("feature = 'id=i1'").count() == 1
    assert f.roles == {"kind": "cat", "size": "num", "flag": "bin"}
    assert fe.select_features(df, "itemid", f.roles, ["kind"]).columns == ["itemid", "kind"]
    assert fe.split_roles(df, ["size"], ["size"])[1] == ["size_num"]
    edges = [0.0, 1.0, 2.0, 3.0]
    got = spark.createDataFrame([(float("nan"),), (None,), (2.5,)], "x double").select(fe.bin_column(F.col("x"), edges, "min"), fe.bin_column(F.col("x"), edges, 1.5), fe.bin_column(F.col("x"), edges))
    assert [tuple(r) for r in got.collect()] == [(0, 1, None), (0, 1, None), (2, 2, 2)]


def test_feature_similarity_is_alike_on_both_sides_of_the_bound(spark, monkeypatch):
    rows = [(f"i{i}", f"f{j}", 1.0 if (i * j) % 3 else -1.0) for i in range(12) for j in range(8) if (i + j) % 3]
    df = spark.createDataFrame(rows, "itemid string, feature string, weight double")
    take = lambda: sorted((r.source, r.target, round(r.prediction, 6)) for r in si.feature_similarity(df, 4, 6).collect())
    dense = take()
    monkeypatch.setattr(si, "DENSE", 2)
    assert take() == dense


def test_small_relational_operators(spark, tmp_path):
    o = spark.createDataFrame([("u", "a", 1.0), ("u", "b", 1.0), ("v", "a", 1.0), ("v", "c", 1.0), ("w", "b", 1.0)], KIND)
    items = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "itemid string, x int")
    known, seen = ob.known_together(o, items)
    assert known.count() == 4 and seen.count() == 2
    assert {(r.itemid, r.n) for r in ob.common_items(o, "a", 1).collect()} == {("a", 2), ("b", 1), ("c", 1)}
    assert ob.items_of_user(o, items, "v").count() == 1
    codes = fe.encode_labels(o, "itemid")
    coded = ob.encode_ids(o, {"itemid": codes})
    assert [r.back for r in ob.decode_ids(coded, "itemid_code", codes, "back").orderBy("userid", "itemid").collect()] == ["a", "b", "a", "c", "b"]
    assert [r.itemid for r in ob.join_scores(items, spark.createDataFrame([("z", 2.0), ("a", 1.0)], "itemid string, prediction double")).collect()] == ["z", "a", "b"]
    assert ob.filter_ids(o, "userid", "u").count() == 2 and ob.filter_ids(o, "userid", ["u", "w"]).count() == 3
    assert ob.sample_rows(o, 2).count() == 2
    with pytest.raises(ValueError):
        ob.cluster_items(items, 1)
    flags = ob.token_flags(spark.createDataFrame([(1, "Sci-Fi|War"), (2, None)], "id int, g string"), "id", "g", ["Sci-Fi", "War"])
    assert [tuple(r) for r in flags.orderBy("id").collect()] == [(1, 1, 1), (2, 0, 0)]
    rows = spark.createDataFrame([("a", "1"), ("b", None), ("c", "x")], "id string, lat string").withColumn("long", F.lit("2"))
    assert en.clean_places(rows).count() == 1
    low = si.floor_shift(spark.createDataFrame([(-0.5,), (1.0,)], "prediction double"))
    assert sorted(r[0] for r in low.collect()) == pytest.approx([0.01, 1.51])
    report = {r.label: r for r in mo.classification_report(spark.createDataFrame([(1, 1), (1, 0), (0, 0)], "label int, prediction int")).collect()}
    assert report[1].precision == 1 and report[1].recall == 0.5 and report[0].f1 == pytest.approx(2 / 3)
    assert mo.r2(spark.createDataFrame([(1.0, 1.0), (2.0, 2.0)], "rating double, prediction double")) == 1
    assert fits_broadcast(items, 10, 100) and not fits_broadcast(items, 100, 100)
    files.save_tables({"items": items}, str(tmp_path / "model"))
    assert files.load_tables(spark, str(tmp_path / "model"), ["items"])["items"].count() == 3
    assert math.isclose(fe.quantile_edges(items, "x", 2)[0], 2.0)


def test_rings_round_a_pole(spark):
    from quern.operators.places import inside_pairs

    df = spark.createDataFrame([("n", 89.0, 10.0), ("e", 80.1, 95.0), ("o", 60.0, 10.0), ("s", -89.0, 5.0)], "id string, lat double, long double")
    rows = [("north", i, 70.0, -180.0 + i * 60) for i in range(6)] + [("south", i, -70.0, 170.0 - i * 60) for i in range(6)]
    ring = spark.createDataFrame(rows, "region_id string, vertex_no int, lat double, long double")
    assert {tuple(r) for r in inside_pairs(df, "id", ring).collect()} == {("n", "north"), ("e", "north"), ("s", "south")}
