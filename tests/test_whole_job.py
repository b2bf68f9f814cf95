"""Co-occurrence against numpy over all pairs, on both sides of every bound."""

import numpy as np
import pandas as pd
import pytest

from quern.operators import cooccurrence as co
from quern.operators import scoring as sc


def fixture(spark, seed=3, users=30, items=24, hot=True):
    rng = np.random.default_rng(seed)
    rows = [(f"u{u}", f"i{i:02d}", float(rng.integers(1, 6))) for u in range(users) for i in rng.choice(items, rng.integers(1, 7), replace=False)]
    if hot:
        rows += [("hot", f"i{i:02d}", 2.0) for i in range(items)]
    extra = [(None, "i01", 1.0), ("u1", None, 1.0)]
    return pd.DataFrame(rows, columns=["u", "i", "r"]), spark.createDataFrame(rows + extra, "userid string, itemid string, rating double")


def base_matrix(df, f=lambda r: np.ones_like(r)):
    items = sorted(df.i.unique())
    m = df.pivot_table(index="u", columns="i", values="r", aggfunc="sum")[items].to_numpy()
    m = np.where(np.isnan(m), 0, f(np.nan_to_num(m)))
    c = m.T @ m
    np.fill_diagonal(c, 0)
    return items, c


def best(items, c, n, digits=9, both=True):
    t = c.sum(1, keepdims=True)
    s = np.divide(c, t, out=np.zeros_like(c), where=t > 0)
    s = s + s.T if both else s
    out = {}
    for i, row in enumerate(s):
        order = sorted((-np.floor(x * 10**digits + 0.5), items[j]) for j, x in enumerate(row) if x > 0)[:n]
        out[items[i]] = [(b, round(-x / 10**digits, 6)) for x, b in order]
    return {k: v for k, v in out.items() if v}


def rows_of(df, source="itemid_source", target="itemid"):
    out = {}
    for r in df.orderBy(source, "prediction", ascending=[True, False]).collect():
        out.setdefault(r[source], []).append((r[target], round(r["prediction"], 6)))
    return {k: sorted(v, key=lambda x: (-x[1], x[0])) for k, v in out.items()}


def near(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert [b for b, _ in got[k]] == [b for b, _ in sorted(v, key=lambda x: (-x[1], x[0]))]
        assert sorted(x for _, x in got[k]) == pytest.approx(sorted(x for _, x in v), abs=2e-6)


@pytest.mark.parametrize("chunk,small", [(4, True), (2048, True), (2048, False)])
@pytest.mark.parametrize("trans,least", [("ones", 2), ("log", 0)])
def test_pairs_alike_on_both_sides_of_each_bound(spark, monkeypatch, chunk, small, trans, least):
    df, o = fixture(spark)
    monkeypatch.setattr(co, "CHUNK", chunk)
    if not small:
        monkeypatch.setattr(co, "BROADCAST_BYTES", 0)
    f = {"ones": lambda r: (r > 0) * 1.0, "log": lambda r: np.log10(r + 1), "none": lambda r: r}[trans]
    items, c = base_matrix(df, f)
    c[c < least] = 0
    want = best(items, c, 5)
    near(rows_of(co.top_cooccurring(o, 5, trans=trans, min_count=least)), want)


def higher(c, degree, ratio, decay, least):
    h = c.copy()
    bound = max(least, np.percentile(h[h > 0], int(100 * ratio))) if ratio else least
    h[h < bound] = 0
    for i in range(degree - 1):
        h = h + decay ** (i + 1) * h @ h
        np.fill_diagonal(h, 0)
    return c + h * c.sum() / (h.sum() + 1)


@pytest.mark.parametrize("degree", [2, 3])
@pytest.mark.parametrize("ratio,decay,least", [(0.5, 0.3, 3), (0.0, 0.5, 1)])
def test_higher_degrees(spark, monkeypatch, degree, ratio, decay, least):
    df, o = fixture(spark)
    items, c = base_matrix(df)
    want = best(items, higher(c, degree, ratio, decay, least), 5, 8)
    plain = co.symmetrise(co.normalise_rows(co.higher_degree(co.cooccurrence(o), degree, ratio, decay, least)))
    near(rows_of(co.top_similar(plain, 5, 8)), want)
    if degree == 2:
        monkeypatch.setattr(sc, "CELLS", 64)
        near(rows_of(sc.top_second_degree(o, 5, 8, ratio, decay, least)), want)


def test_users_and_longest_lists(spark):
    df, o = fixture(spark)
    swapped = df.rename(columns={"u": "i", "i": "u"})
    users, c = base_matrix(swapped)
    near(rows_of(co.top_cooccurring(o, 4, on="itemid", of="userid", both=False, source="userid", target="other"), "userid", "other"), best(users, c, 4, both=False))
    items, c = base_matrix(df[df.u != "hot"])
    near(rows_of(co.top_cooccurring(o, 5, max_list=20)), best(items, c, 5))
    assert co.top_cooccurring(o.limit(0), 5).count() == 0


def test_quantiles_are_exact(spark):
    from quern.operators.quantiles import grouped_quantiles, quantiles

    x = np.random.default_rng(1).integers(0, 40, 501).astype(float)
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(x)] + [("a", None), ("a", float("nan"))], "g string, v double")
    at = [0.0, 0.1, 0.333, 0.5, 1.0]
    assert quantiles(df, "v", at) == pytest.approx(list(np.quantile(x, at)))
    got = grouped_quantiles(df, "g", "v", at)
    assert got["b"] == pytest.approx(list(np.quantile(x[::3], at))) and len(got) == 2
    assert quantiles(df.limit(0), "v", at) == []


def test_ranks_share_ties(spark):
    from quern.operators.ranks import mean_ranks

    df = spark.createDataFrame([("g", "a", 0.0), ("g", "b", -0.0), ("g", "c", 5.0), ("h", "a", 1.0)], "g string, i string, s double")
    got = {(r.g, r.i): (r.rank, r.n) for r in mean_ranks(df, ["g"], "s", listed="n").collect()}
    assert got == {("g", "a"): (2.5, 3), ("g", "b"): (2.5, 3), ("g", "c"): (1.0, 3), ("h", "a"): (1.0, 1)}


def test_positions_take_minus_zero_as_zero(spark):
    from pyspark.sql import functions as F

    from quern.operators.positions import with_positions

    df = spark.createDataFrame([(-0.0 if i % 2 else 0.0, i) for i in range(200)], "g double, i int")
    got = [r.p for r in with_positions(df, ["g"], [F.col("i").asc()], out="p", partitions=7).orderBy("i").collect()]
    assert got == list(range(1, 201))


def test_rows_without_a_time_come_last(spark):
    from quern.operators.observations import observations

    df = spark.createDataFrame([("u", "i", 1.0, None), ("u", "i", 2.0, 7), ("v", "i", 3.0, None)], "u string, i string, r double, t long")
    assert {(r.userid, r.rating, r.ts) for r in observations(df, "u", "i", "r", "t").collect()} == {("u", 2.0, 7), ("v", 3.0, None)}
