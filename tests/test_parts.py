"""Recommendations made part by part: only histories travel, and every way gives the same rows."""

import numpy as np
import pandas as pd
import pytest

from quern.operators import components as cc
from quern.operators import cooccurrence as co
from quern.operators import scoring as sc


def observations(spark, seed=5):
    """Two halves that share nothing, one with a long list."""
    rng = np.random.default_rng(seed)
    rows = [(f"{h}u{u}", f"{h}i{i:02d}", float(rng.integers(1, 6))) for h in "ab" for u in range(20) for i in rng.choice(18, rng.integers(2, 7), replace=False)]
    rows += [("ahot", f"ai{i:02d}", 2.0) for i in range(15)]
    df = pd.DataFrame(rows, columns=["u", "i", "r"])
    return df, spark.createDataFrame(rows, "userid string, itemid string, rating double")


def item_scores(df):
    m = df.pivot_table(index="u", columns="i", values="r", aggfunc="sum").fillna(0)
    h = (m.to_numpy() > 0).astype(float)
    c = h.T @ h
    np.fill_diagonal(c, 0)
    t = np.maximum(c.sum(1), 1e-300)
    s = np.round(h @ np.round(c / t[:, None] + c / t, 9), 9)
    s[h > 0] = 0
    return m, s


def user_scores(df):
    m = df.pivot_table(index="u", columns="i", values="r", aggfunc="sum").fillna(0)
    h = (m.to_numpy() > 0).astype(float)
    c = h @ h.T
    np.fill_diagonal(c, 0)
    s = np.round(np.round(c / np.maximum(c.sum(1, keepdims=True), 1e-300), 9) @ m.to_numpy(), 9)
    s[h > 0] = 0
    return m, s


def best(m, s, n):
    out = {}
    for u, row in zip(m.index, s):
        out[u] = sorted(((-round(float(x), 9), i) for x, i in zip(row, m.columns) if x > 0))[:n]
    return {k: v for k, v in out.items() if v}


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.userid, []).append((-r.prediction, r.itemid))
    return {k: sorted(v) for k, v in out.items()}


def alike(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert [i for _, i in got[k]] == [i for _, i in v]
        assert [x for x, _ in got[k]] == pytest.approx([x for x, _ in v], abs=2e-8)


def refuse(*_):
    raise AssertionError("pairs would travel")


@pytest.mark.parametrize("per,held", [(2_000_000, 8_000_000), (40, 8_000_000), (2_000_000, 20)])
def test_items_alike_by_part_block_and_pairs(spark, monkeypatch, per, held):
    df, o = observations(spark)
    monkeypatch.setattr(sc, "PAIRS", per)
    monkeypatch.setattr(sc, "HELD", held)
    if held > 20:
        monkeypatch.setattr(co, "with_pairs", refuse)
    alike(rows_of(sc.recommend_by_items(o, 3)), best(*item_scores(df), 3))


def test_parts_are_the_connected_ones(spark):
    lists = spark.createDataFrame([([0, 1],), ([4, 5],), ([1, 2],), ([3],)], "codes array<int>")
    found = cc.grouped(lists, np.array([1.0, 2, 1, 0, 1, 1]), 1, 100)
    own = found.group.tolist()
    assert own[0] == own[1] == own[2] and own[4] == own[5] and len({own[0], own[4]}) == 2
    assert found.largest <= 5 and (found.block < found.blocks[found.group]).all()


def test_cut_leaves_no_shuffle_files(spark):
    from quern.scratch import cut

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    seen = []
    df = spark.range(10).repartition(2, "id")
    write = type(df.write).parquet
    try:
        type(df.write).parquet = lambda self, *a, **k: (seen.append(spark.conf.get(key)), write(self, *a, **k))[1]
        cut(df)
    finally:
        type(df.write).parquet = write
    assert seen == ["true"] and spark.conf.get(key, "false") == "false"


@pytest.mark.parametrize("per", [2_000_000, 40])
def test_ranks_of_held_pairs_and_the_first(spark, monkeypatch, per):
    df, o = observations(spark)
    monkeypatch.setattr(sc, "PAIRS", per)
    want = {(u, i): k for u, v in best(*item_scores(df), 8).items() for k, (_, i) in enumerate(v)}
    held = spark.createDataFrame([p for p, k in want.items() if k % 3 == 0] + [("au1", "bi01"), ("nobody", "ai01")], "userid string, itemid string")
    got = {(r.userid, r.itemid): r["rank"] for r in sc.recommend_by_items(o, 8, hold=held, top=2).collect()}
    needed = {p: k for p, k in want.items() if k < 2 or k % 3 == 0}
    assert needed.items() <= got.items() <= want.items()
    assert per == 40 or got == needed  # whole parts: no other rank leaves its task


@pytest.mark.parametrize("query", ["metrics_per_user", "metrics_report", "evaluate_fitted"])
def test_evaluation_sends_no_pairs_and_no_whole_lists(spark, sf, monkeypatch, query):
    from quern.plans import core_queries

    monkeypatch.setattr(co, "with_pairs", refuse)
    monkeypatch.setattr(sc.ob, "zero_ranks", refuse)
    monkeypatch.setattr(cc, "TASKS", 1e-9)
    monkeypatch.setattr(sc, "PAIRS", 1e12)
    assert core_queries.QUERIES[query](spark, sf).count() > 0


def test_split_by_time_at_every_edge(spark):
    from quern.operators import observations as ob

    rows = [(f"u{k}", None if k % 7 == 0 else k // 3) for k in range(30)]
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    df = spark.createDataFrame(rows, "u string, t int")
    for ratio in (0.0, 0.2, 0.34, 0.9, 1.0):
        got = {r.u for r in ob.split_by_time(df, "t", ratio=ratio, ties=("u",)).filter("part = 'test'").collect()}
        assert got == {u for u, _ in order[: int(29 * ratio)]}


@pytest.mark.parametrize("per,held", [(2_000_000, 8_000_000), (40, 8_000_000), (2_000_000, 20)])
def test_users_alike_by_part_block_and_pairs(spark, monkeypatch, per, held):
    df, o = observations(spark)
    monkeypatch.setattr(sc, "PAIRS", per)
    monkeypatch.setattr(sc, "HELD", held)
    if held > 20:
        monkeypatch.setattr(co, "with_pairs", refuse)
    alike(rows_of(sc.recommend_by_users(o, 3)), best(*user_scores(df), 3))


@pytest.mark.parametrize("least", [0, 2, 3])
@pytest.mark.parametrize("both", [True, False])
def test_top_similar_by_part_as_by_pairs(spark, monkeypatch, least, both):
    _, o = observations(spark)
    rows = lambda: sorted(tuple(r) for r in co.top_cooccurring(o, 4, min_count=least, both=both).collect())
    with monkeypatch.context() as m:
        m.setattr(sc, "HELD", 20)
        want = rows()
    monkeypatch.setattr(co, "with_pairs", refuse)
    assert rows() == want and want


def test_second_degree_sends_an_entry_to_its_two_blocks_only():
    import pyarrow as pa

    keys, counts = np.array([(0 << 32) | 1, (0 << 32) | 2, (2 << 32) | 5]), np.array([1, 4, 2])
    batch = pa.RecordBatch.from_pydict({"bucket": pa.array([0], pa.int32()), **{k: pa.array([v], pa.binary()) for k, v in zip(("keys", "counts"), co.pack(keys, counts, False))}})
    out = [r for b in sc._split_cells(2)([batch]) for r in b.to_pylist()]
    got = {(r["j"], *map(int, p)) for r in out for p in zip(*co.decode(r["keys"], r["counts"]))}
    assert got == {(0, keys[1], 4), (1, keys[0], 1), (1, keys[2], 2)}
    high = [co.decode(r["keys"], r["counts"]) for b in sc._at_least(2)([batch]) for r in b.to_pylist()]
    assert [x.tolist() for x in high[0]] == [keys[1:].tolist(), [4, 2]]


@pytest.mark.parametrize("exclusions", [True, False])
def test_ranks_of_factors_without_their_lists(spark, monkeypatch, exclusions):
    from quern.operators import observations as ob
    from quern.operators import recommenders as rc
    from quern.operators import similarity as si

    _, o = observations(spark)
    rec = rc.RankingRecommender(epochs=1, rank=4).fit(o)
    monkeypatch.setattr(si, "BLOCK", 7)
    held = spark.createDataFrame([(f"{h}u{u}", f"{g}i{i:02d}") for h in "ab" for u in range(6) for g in "ab" for i in range(0, 18, 5)], "userid string, itemid string")
    want = {(r.userid, r.itemid): r["rank"] for r in ob.zero_ranks(rec.recommend(n=36, exclusions=exclusions), "userid", "prediction", "itemid").collect()}
    asked = {tuple(r) for r in held.collect()}
    got = {(r.userid, r.itemid): r["rank"] for r in rec._ranked(rec.users, None, 36, exclusions, held, 2).collect()}
    assert got == {p: k for p, k in want.items() if k < 2 or p in asked}


@pytest.mark.parametrize("query", ["cascade", "rank_zero_based", "recommend_lists"])
def test_queries_over_recommendations_send_no_pairs(spark, sf, monkeypatch, query):
    from quern.plans import core_queries

    monkeypatch.setattr(co, "with_pairs", refuse)
    assert core_queries.QUERIES[query](spark, sf).count() > 0


def test_candidates_of_the_own_cluster_and_its_neighbours(spark):
    from quern.operators import models as mo

    members = spark.createDataFrame([("user", "u", 0), *[("item", f"i{c}", c) for c in range(4)]], "side string, id string, cluster int")
    near = spark.createDataFrame([(a, b, 1.0 if abs(a - b) < 2 else 0.5 / abs(a - b)) for a in range(4) for b in range(4)], "cluster int, other int, cosine double")
    for ratio, want in ((0.1, {"i0", "i1"}), (0.5, {"i0", "i1", "i2"}), (1.0, {"i0", "i1", "i2", "i3"})):
        assert {r.itemid for r in mo.cluster_candidates(members, near, 4, ratio).collect()} == want
