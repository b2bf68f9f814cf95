"""Recommenders as fitted objects: parameters, fit, recommend, similar, predict, evaluate, and ensembles of them.

A fitted recommender holds tables (cut once, in the shared folder); every answer is a DataFrame.
Observations are (userid, itemid, rating[, ts]); results (userid, itemid, prediction).
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import cooccurrence as co
from quern.operators import ensembles as en
from quern.operators import metrics as me
from quern.operators import models as mo
from quern.operators import observations as ob
from quern.operators import recommend as re_
from quern.operators import scoring as sc
from quern.operators import similarity as si
from quern.scratch import cut

SERVED_BYTES = 256 << 20


class Recommender:
    """Base: parameters, training data, exclusions, evaluation. Sub-classes give ``_fit`` and ``_scores``."""

    defaults: dict = {}

    def __init__(self, **params) -> None:
        self.params = dict(self.defaults)
        self.set_params(**params)
        self.train: DataFrame | None = None
        self.served: Served | None = None

    def set_params(self, **params) -> Recommender:
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        self.params.update(params)
        return self

    def get_params(self) -> dict:
        return dict(self.params)

    def clone(self) -> Recommender:
        """The same kind and parameters, not fitted."""
        other = copy.copy(self)
        other.params, other.train, other.served = dict(self.params), None, None
        return other

    def fit(self, train: DataFrame, exclude: DataFrame | None = None, exclude_train: bool = True) -> Recommender:
        """Learn from observations; repeated pairs add up, rows with a null id are left out."""
        self.train = cut(ob.pair_sums(train), "train")
        self.users, self.items = (cut(self.train.select(c).distinct(), c) for c in ("userid", "itemid"))
        self.set_excluded(exclude, exclude_train)
        self._fit()
        return self

    def set_excluded(self, exclude: DataFrame | None = None, exclude_train: bool = True) -> None:
        """The pairs never recommended: the training pairs, others, or both."""
        if exclude is None and not exclude_train:
            raise ValueError("give the pairs to exclude, an empty table for none")
        own = self.train.select("userid", "itemid")
        self.own_excluded = exclude is None
        if exclude is None:
            self.excluded = own
        else:
            more = exclude.select("userid", "itemid")
            self.excluded = cut((own.unionByName(more) if exclude_train else more).distinct(), "excluded")

    def known(self, ids: DataFrame | Sequence[str] | None, key: str) -> DataFrame:
        """The given ids that were in training; all for None."""
        every = self.users if key == "userid" else self.items
        if ids is None:
            return every
        if not isinstance(ids, DataFrame):
            ids = every.sparkSession.createDataFrame([(str(i),) for i in ids], f"{key} string")
        return every.join(ids.select(key).distinct(), key, "left_semi")

    def recommend(self, users=None, items=None, n: int = 10, exclusions: bool = True) -> DataFrame:
        """(userid, itemid, prediction): the n best per known user, best first by score, then itemid."""
        own = self.known(users, "userid")
        targets = None if items is None else self.known(items, "itemid")
        return self._recommend(own, targets, n, exclusions)

    def _recommend(self, users: DataFrame, items: DataFrame | None, n: int, exclusions: bool) -> DataFrame:
        return re_.recommend(self._scores(users), n, self.excluded if exclusions else None, None, items)

    def lists(self, users=None, items=None, n: int = 10, exclusions: bool = True) -> DataFrame:
        """recommend, as (userid, itemid array, prediction array)."""
        return ob.to_lists(self.recommend(users, items, n, exclusions), "userid", "prediction", "itemid", n)

    def similar(self, items=None, targets=None, n: int = 10) -> DataFrame:
        raise NotImplementedError("this recommender has no similarities of items")

    def predict(self, pairs: DataFrame) -> DataFrame:
        """Adds the prediction to (userid, itemid, ..) rows of known users and items, 0 where nothing links them."""
        rows = pairs.join(self.users, "userid", "left_semi").join(self.items, "itemid", "left_semi")
        scores = self._scores(rows.select("userid").distinct())
        return rows.join(scores, ["userid", "itemid"], "left").select(*pairs.columns, F.coalesce("prediction", F.lit(0.0)).alias("prediction"))

    def serve(self) -> Served:
        """The model in the driver's memory, for single users at low latency; only while it is under SERVED_BYTES."""
        self.served = self._serve()
        return self.served

    def predict_for_user(self, user: str, items: Sequence[str], training_last: bool = True, combine_order: bool = False) -> pd.DataFrame:
        """(userid, itemid, prediction) of one user and a few items, the best first; unknown and (if asked) known pairs at -inf."""
        if self.served is None:
            self.serve()
        return self.served.predict_for_user(user, items, training_last, combine_order)

    def evaluate(self, tests: Mapping[str, DataFrame], k: int = 10, n: int | None = 100, items=None, include_train: bool = True, prefix: str = "") -> DataFrame:
        """One row of metrics per test set ('<prefix><name>test') and for the training data ('<prefix>train').

        Users are the known ones of any test set. Their n best items (all for None: the exact evaluation)
        are ranked once for all test sets, without excluded pairs and within ``items``; for the training
        data with them. Test items that were not ranked are misses.
        """
        users = cut(self.known(ob.users_of_any(*tests.values()), "userid"), "users")
        n_items = self.items.count()
        width = n_items if n is None else min(n, n_items)
        own = lambda df, name: df.select(F.lit(name).alias("dataset"), "userid", "itemid").join(users, "userid", "left_semi").join(self.items, "itemid", "left_semi")
        targets = None if items is None else self.known(items, "itemid")
        held = cut(reduce(DataFrame.unionByName, [own(df, f"{prefix}{name}test") for name, df in tests.items()]), "tests")
        out = me.report(held, cut(self._ranked(users, targets, width, True, held.select("userid", "itemid").distinct(), k), "ranks"), n_items, k)
        if include_train:
            held = own(self.train, f"{prefix}train")
            out = me.report(held, cut(self._ranked(users, None, width, False, held.select("userid", "itemid"), k), "ranks"), n_items, k).unionByName(out)
        return out

    def _ranked(self, users: DataFrame, items: DataFrame | None, n: int, exclusions: bool, held: DataFrame, k: int) -> DataFrame:
        """(userid, itemid, rank) of the n best; rows beyond rank k that are not in ``held`` may be left out."""
        return ob.zero_ranks(self._recommend(users, items, n, exclusions), "userid", "prediction", "itemid").select("userid", "itemid", "rank")

    def _fit(self) -> None:
        raise NotImplementedError

    def _scores(self, users: DataFrame) -> DataFrame:
        raise NotImplementedError

    def _serve(self) -> Served:
        raise NotImplementedError("this recommender cannot be served from memory")


class Served:
    """Histories and a similarity matrix, or factors, in numpy."""

    def __init__(self, users: dict, items: dict, history: dict, rows: tuple | None = None, factors: tuple | None = None) -> None:
        self.users, self.items, self.history, self.rows, self.factors = users, items, history, rows, factors

    def scores(self, user: int, codes: np.ndarray) -> np.ndarray:
        if self.factors is not None:
            u, v, b = self.factors
            return v[codes] @ u[user] + b[codes]
        ptr, cols, vals = self.rows
        acc = np.zeros(len(ptr) - 1)
        for j in self.history.get(user, ()):
            acc[cols[ptr[j] : ptr[j + 1]]] += vals[ptr[j] : ptr[j + 1]]
        return acc[codes]

    def predict_for_user(self, user: str, items: Sequence[str], training_last: bool = True, combine_order: bool = False) -> pd.DataFrame:
        names = [str(i) for i in items]
        out = np.full(len(names), -np.inf)
        own = self.users.get(str(user))
        if own is not None:
            codes = np.array([self.items.get(i, -1) for i in names], np.int64)
            known = codes >= 0
            out[known] = self.scores(own, codes[known])
            if training_last:
                seen = set(self.history.get(own, ()))
                out[[c in seen for c in codes.tolist()]] = -np.inf
            if combine_order:
                out = (pd.Series(np.arange(len(names), 0, -1)).rank().to_numpy() + pd.Series(out).rank().to_numpy()) / 2
        order = np.argsort(-out, kind="stable")
        return pd.DataFrame({"userid": str(user), "itemid": np.array(names, dtype=object)[order], "prediction": out[order]})


def _histories(rec: Recommender, users: dict, items: dict) -> dict:
    local = rec.train.select("userid", "itemid").toPandas()
    history: dict[int, list[int]] = {}
    for u, i in zip(local["userid"].map(users), local["itemid"].map(items)):
        history.setdefault(u, []).append(i)
    return history


def _served_bound(rows: int, width: int) -> None:
    if rows * width > SERVED_BYTES:
        raise ValueError("the model is too large for the driver's memory; use recommend or predict")


class SimilarityTable(Recommender):
    """Scores by a table (itemid_source, itemid, prediction) of similarities, made symmetric by adding its mirror."""

    defaults = {"floor": 0.01}

    def fit_table(self, train: DataFrame, table: DataFrame) -> SimilarityTable:
        self.table = table
        return self.fit(train)

    def _fit(self) -> None:
        rows = self.table.select(F.col("itemid_source").alias("a"), F.col("itemid").alias("b"), F.col("prediction").alias("value"))
        sim = co.symmetrise(rows).select(F.col("a").alias("itemid_source"), F.col("b").alias("itemid"), F.col("value").alias("prediction"))
        self.sim = cut(si.floor_shift(cut(sim, "raw"), floor=self.params["floor"]), "similarities")

    def extend(self, more: DataFrame) -> SimilarityTable:
        """Adds a further table's similarities (and their mirror) to the fitted ones."""
        both = more.select("itemid_source", "itemid", "prediction").unionByName(more.select(F.col("itemid").alias("itemid_source"), F.col("itemid_source").alias("itemid"), "prediction"))
        self.sim = cut(self.sim.unionByName(both).groupBy("itemid_source", "itemid").agg(F.sum("prediction").alias("prediction")), "similarities")
        self.served = None
        return self

    def _scores(self, users: DataFrame) -> DataFrame:
        return re_.item_scores(self.train.join(users, "userid", "left_semi"), self.sim)

    def similar(self, items=None, targets=None, n: int = 10) -> DataFrame:
        rows = self.sim.filter("itemid_source <> itemid")
        if items is not None:
            rows = rows.join(self.known(items, "itemid").withColumnRenamed("itemid", "itemid_source"), "itemid_source", "left_semi")
        if targets is not None:
            rows = rows.join(self.known(targets, "itemid"), "itemid", "left_semi")
        return co.top_similar(rows.select(F.col("itemid_source").alias("a"), F.col("itemid").alias("b"), F.col("prediction").alias("value")), n)

    def _serve(self) -> Served:
        _served_bound(self.sim.count(), 24)
        _served_bound(self.train.count(), 100)
        users, items = ({v: i for i, v in enumerate(sorted(r[0] for r in df.collect()))} for df in (self.users, self.items))
        local = self.sim.toPandas()
        a, b = local["itemid_source"].map(items).to_numpy(), local["itemid"].map(items).to_numpy()
        keep = ~(pd.isna(a) | pd.isna(b))
        a, b, v = a[keep].astype(np.int64), b[keep].astype(np.int64), local["prediction"].to_numpy()[keep]
        order = np.argsort(a, kind="stable")
        return Served(users, items, _histories(self, users, items), rows=(np.searchsorted(a[order], np.arange(len(items) + 1)), b[order], v[order]))


class ItemCooccurrence(SimilarityTable):
    """Items by the users they share; see quern.operators.cooccurrence for the parameters."""

    defaults = {"trans": "ones", "degree": 1, "base_min_cooccurrence": 1, "prune_ratio": 0.0, "decay": 0.5, "min_cooccurrence": 1, "normalise": True}

    def _plain(self) -> bool:
        p = self.params
        return p["trans"] == "ones" and p["degree"] == 1 and p["base_min_cooccurrence"] <= 1 and p["normalise"]

    def _fit(self) -> None:
        self.made: DataFrame | None = None

    @property
    def sim(self) -> DataFrame:
        """The whole similarity table, made when it is first asked for."""
        if self.made is None:
            p = self.params
            base = co.cooccurrence(self.train, trans=p["trans"], min_count=p["base_min_cooccurrence"] if p["base_min_cooccurrence"] > 1 else 0)
            high = co.higher_degree(base, p["degree"], p["prune_ratio"], p["decay"], p["min_cooccurrence"])
            sim = co.symmetrise(co.normalise_rows(high) if p["normalise"] else high)
            self.made = cut(sim.select(F.col("a").alias("itemid_source"), F.col("b").alias("itemid"), F.round("value", 9).alias("prediction")), "similarities")
        return self.made

    @sim.setter
    def sim(self, table: DataFrame) -> None:
        self.made = table

    def _direct(self, exclusions: bool) -> bool:
        """Whether the similarity need not be made as a table: default parameters, and just the training pairs left out."""
        return self._plain() and exclusions and self.made is None and self.own_excluded

    def _recommend(self, users: DataFrame, items: DataFrame | None, n: int, exclusions: bool) -> DataFrame:
        if self._direct(exclusions):
            return sc.recommend_by_items(self.train, n, users, items)
        return super()._recommend(users, items, n, exclusions)

    def _ranked(self, users: DataFrame, items: DataFrame | None, n: int, exclusions: bool, held: DataFrame, k: int) -> DataFrame:
        if self._direct(exclusions):
            return sc.recommend_by_items(self.train, n, users, items, hold=held, top=k).select("userid", "itemid", "rank")
        return super()._ranked(users, items, n, exclusions, held, k)

    def similar(self, items=None, targets=None, n: int = 10) -> DataFrame:
        if self._plain() and items is None and targets is None:
            return co.top_cooccurring(self.train, n)
        return super().similar(items, targets, n)

    def fit_batches(self, batches: Sequence[DataFrame]) -> ItemCooccurrence:
        """Batch after batch; counts are additive over pairs, so this is the fit of all of them together."""
        return self.fit(reduce(DataFrame.unionByName, [b.select("userid", "itemid", "rating") for b in batches]))


class UserCooccurrence(Recommender):
    """Items of the users that share items; similarities of users are row-normalised counts."""

    def _fit(self) -> None:
        return None

    def _recommend(self, users: DataFrame, items: DataFrame | None, n: int, exclusions: bool) -> DataFrame:
        if exclusions and items is None:
            return sc.recommend_by_users(self.train, n).join(users, "userid", "left_semi")
        return super()._recommend(users, items, n, exclusions)

    def _scores(self, users: DataFrame) -> DataFrame:
        sim = co.normalise_rows(co.cooccurrence(self.train, on="itemid", of="userid")).select(F.col("a").alias("userid"), F.col("b").alias("other"), F.round("value", 9).alias("prediction"))
        return re_.user_scores(self.train, sim.join(users, "userid", "left_semi"))


class FeatureSimilarity(SimilarityTable):
    """Similarities of items by features (itemid, feature, weight): each item's ``n_simil`` most similar ones, mirrored."""

    defaults = {"n_simil": 100, "floor": 0.01}

    def fit_features(self, train: DataFrame, features: DataFrame) -> FeatureSimilarity:
        found = si.feature_similarity(features, self.params["n_simil"]).toDF("itemid_source", "itemid", "prediction")
        return self.fit_table(train, found)


class Factors(Recommender):
    """Biases and factors of users and items; predictions are dot products."""

    def set_factors(self, users: DataFrame, items: DataFrame) -> None:
        self.user_factors, self.item_factors = cut(users, "user_factors"), cut(items, "item_factors")

    def _recommend(self, users: DataFrame, items: DataFrame | None, n: int, exclusions: bool) -> DataFrame:
        """Exact: every asked user against every item, in blocks."""
        own = self.user_factors.join(users.withColumnRenamed("userid", "id"), "id", "left_semi")
        targets = self.item_factors if items is None else self.item_factors.join(items.withColumnRenamed("itemid", "id"), "id", "left_semi")
        left = self.excluded if exclusions else None
        return si.top_vectors(targets, n, "dot", vec_col="factors", bias_col="bias", sources=own, exclude=left, same_kind=False).toDF("userid", "itemid", "prediction")

    def _ranked(self, users: DataFrame, items: DataFrame | None, n: int, exclusions: bool, held: DataFrame, k: int) -> DataFrame:
        """Ranks of the held pairs by counting what comes before them, and the first k."""
        first = ob.zero_ranks(self._recommend(users, items, min(n, k), exclusions), "userid", "prediction", "itemid").select("userid", "itemid", "rank")
        own = self.user_factors.join(users.withColumnRenamed("userid", "id"), "id", "left_semi")
        targets = self.item_factors if items is None else self.item_factors.join(items.withColumnRenamed("itemid", "id"), "id", "left_semi")
        ranks = si.held_ranks(targets, own, held, self.excluded if exclusions else None).toDF("userid", "itemid", "rank").filter(F.col("rank") < n)
        return first.unionByName(ranks).groupBy("userid", "itemid").agg(F.min("rank").alias("rank"))

    def predict(self, pairs: DataFrame) -> DataFrame:
        return re_.factor_scores(pairs, self.user_factors, self.item_factors)

    def _top(self, table: DataFrame, key: str, ids, targets, n: int, mode: str) -> DataFrame:
        asked = None if ids is None else table.join(self.known(ids, key).withColumnRenamed(key, "id"), "id", "left_semi")
        among = table if targets is None else table.join(self.known(targets, key).withColumnRenamed(key, "id"), "id", "left_semi")
        return si.top_vectors(among, n, mode, vec_col="factors", sources=asked if asked is not None else table)

    def similar(self, items=None, targets=None, n: int = 10, mode: str = "cosine") -> DataFrame:
        return self._top(self.item_factors, "itemid", items, targets, n, mode).toDF("itemid_source", "itemid", "prediction")

    def similar_users(self, users=None, targets=None, n: int = 10, mode: str = "cosine") -> DataFrame:
        return self._top(self.user_factors, "userid", users, targets, n, mode).toDF("userid", "other", "prediction")

    def _serve(self) -> Served:
        rank = self.item_factors.select(F.size("factors")).first()
        width = 8 * ((rank[0] if rank else 0) + 8)
        _served_bound(self.user_factors.count() + self.item_factors.count(), width)
        _served_bound(self.train.count(), 100)
        u, v = self.user_factors.toPandas(), self.item_factors.toPandas()
        users, items = {k: i for i, k in enumerate(u["id"])}, {k: i for i, k in enumerate(v["id"])}
        x, y = (np.stack(df["factors"].to_numpy()).astype(float) if len(df) else np.empty((0, 0)) for df in (u, v))
        return Served(users, items, _histories(self, users, items), factors=(x, y, v["bias"].fillna(0.0).to_numpy(dtype=float)))


class AlsRecommender(Factors):
    """Implicit alternating least squares over BM25 weights."""

    defaults = {"rank": 32, "iterations": 5, "reg": 0.1, "seed": 42, "weighted": True}

    def _fit(self) -> None:
        self.set_factors(*mo.als_factors(self.train, **self.params))


class RankingRecommender(Factors):
    """Pairwise ranking by SGD: loss 'bpr', 'warp' (weighted by sampled rank) or 'hinge' (the hardest of some negatives)."""

    defaults = {"rank": 16, "epochs": 10, "rate": 0.05, "reg": 0.01, "seed": 42, "loss": "bpr"}

    def _fit(self) -> None:
        self.set_factors(*mo.bpr_factors(self.train, **self.params))

    def fit_batches(self, batches: Sequence[DataFrame]) -> RankingRecommender:
        """Continues from the item factors of the batches before."""
        start = None
        for batch in batches:
            self.train = cut(ob.pair_sums(batch), "train")
            users, items = mo.bpr_factors(self.train, **self.params, start=start)
            start = cut(items if start is None else items.unionByName(start.join(items.select("id"), "id", "left_anti")), "item_factors")
        self.users, self.items = (cut(self.train.select(c).distinct(), c) for c in ("userid", "itemid"))
        self.set_excluded()
        self.set_factors(users, start)
        return self


class ClusterRecommender(Factors):
    """Factors of ALS, and candidates only from the clusters near a user's own."""

    defaults = {"rank": 16, "iterations": 5, "n_clusters": 10, "ratio": 0.2, "seed": 42}

    def _fit(self) -> None:
        self.set_factors(*mo.als_factors(self.train, rank=self.params["rank"], iterations=self.params["iterations"], seed=self.params["seed"]))
        members, self.near = mo.cluster_factors(self.user_factors, self.item_factors, self.params["n_clusters"], self.params["seed"])
        self.members = cut(members, "members")

    def _recommend(self, users: DataFrame, items: DataFrame | None, n: int, exclusions: bool) -> DataFrame:
        pairs = mo.cluster_candidates(self.members, self.near, self.params["n_clusters"], self.params["ratio"]).join(users, "userid", "left_semi")
        return re_.recommend(re_.factor_scores(pairs, self.user_factors, self.item_factors), n, self.excluded if exclusions else None, None, items)

    def _ranked(self, users: DataFrame, items: DataFrame | None, n: int, exclusions: bool, held: DataFrame, k: int) -> DataFrame:
        return Recommender._ranked(self, users, items, n, exclusions, held, k)  # among the candidates only

    def samples(self, side: str, cluster: int, n: int = 10) -> DataFrame:
        """Some ids of one cluster, drawn by a hash."""
        return ob.sample_rows(self.members.filter((F.col("side") == side) & (F.col("cluster") == cluster)).select("id"), n)


# Ensembles


class RankEnsemble(Recommender):
    """Members' lists combined by rank; an item absent from a list has rank n + 1, or ``fill``."""

    defaults = {"how": "hmean", "fill": None, "n_unfiltered": 100}

    def __init__(self, members: Sequence[Recommender] = (), **params) -> None:
        super().__init__(**params)
        self.members = list(members)

    def _fit(self) -> None:
        for m in self.members:
            m.fit(self.train)

    def set_excluded(self, exclude: DataFrame | None = None, exclude_train: bool = True) -> None:
        super().set_excluded(exclude, exclude_train)
        for m in self.members:
            if m.train is not None:
                m.set_excluded(exclude, exclude_train)

    def _recommend(self, users: DataFrame, items: DataFrame | None, n: int, exclusions: bool) -> DataFrame:
        found = [m.recommend(users, items, n, exclusions) for m in self.members]
        out = en.combine_ranks(found, "userid", "itemid", "prediction", float(self.params["fill"] or n + 1), self.params["how"])
        return re_.top_per_user(out, n)

    def similar(self, items=None, targets=None, n: int = 10) -> DataFrame:
        wide = self.params["n_unfiltered"]
        found = [m.similar(items, targets, wide) for m in self.members]
        out = en.combine_ranks(found, "itemid_source", "itemid", "prediction", float(self.params["fill"] or wide + 1), self.params["how"])
        return co.top_similar(out.select(F.col("itemid_source").alias("a"), F.col("itemid").alias("b"), F.col("prediction").alias("value")), n)

    def predict_for_user(self, user: str, items: Sequence[str], training_last: bool = True, combine_order: bool = False) -> pd.DataFrame:
        names = [str(i) for i in items]
        votes = []
        for m in self.members:
            own = m.predict_for_user(user, names, training_last, combine_order).drop_duplicates("itemid").set_index("itemid")["prediction"]
            votes.append(1 / own.rank(ascending=False).reindex(names).fillna(len(names)).to_numpy())
        forms = {"mean": np.mean, "max": np.max, "min": np.min, "gmean": lambda x, axis: np.exp(np.log(x).mean(axis=axis)), "hmean": lambda x, axis: 1 / (1 / x).mean(axis=axis)}
        how = self.params["how"]
        score = (how if callable(how) else forms[how])(np.stack(votes, axis=1), axis=1)
        order = np.argsort(-score, kind="stable")
        return pd.DataFrame({"userid": str(user), "itemid": np.array(names, dtype=object)[order], "prediction": score[order]})


class CascadeEnsemble(RankEnsemble):
    """The first member's candidates, ordered by the second's predictions."""

    defaults = {"candidates": None}

    def _recommend(self, users: DataFrame, items: DataFrame | None, n: int, exclusions: bool) -> DataFrame:
        first, second = self.members
        return en.cascade(first.recommend(users, items, self.params["candidates"] or 3 * n, exclusions), second.predict, n)


class SimilarityEnsemble(SimilarityTable):
    """Members' similarity lists combined by rank into one table, by which items are then recommended.

    ``sink``, if given, receives each block of lists (itemid_source, itemid array, prediction array), cut
    to ``sink_n``, and None at the end.
    """

    defaults = {"how": "hmean", "n_unfiltered": 100, "floor": 0.01, "blocks": 1, "sink_n": 10}

    def __init__(self, members: Sequence[Recommender] = (), sink: Callable[[DataFrame | None], None] | None = None, **params) -> None:
        super().__init__(**params)
        self.members, self.sink = list(members), sink

    def _fit(self) -> None:
        for m in self.members:
            if m.train is None:
                m.fit(self.train)
        wide, blocks = self.params["n_unfiltered"], self.params["blocks"]
        tables = [cut(m.similar(n=wide), "member") for m in self.members]
        parts = []
        for b in range(blocks):
            own = [t.filter(F.pmod(F.xxhash64("itemid_source"), F.lit(blocks)) == b) for t in tables]
            part = cut(en.combine_ranks(own, "itemid_source", "itemid", "prediction", float(wide + 1), self.params["how"]), "combined")
            if self.sink:
                self.sink(ob.to_lists(part, "itemid_source", "prediction", "itemid", self.params["sink_n"]))
            parts.append(part)
        if self.sink:
            self.sink(None)
        self.table = reduce(DataFrame.unionByName, parts)
        super()._fit()


class SubdivisionEnsemble(RankEnsemble):
    """One model per cell of the items' places, their lists combined by rank.

    ``make`` builds a member; ``places`` is (itemid, lat, long). Cells are an equidense grid of n_lat x n_long
    overlapping by ``margin``, or with ``n_clusters`` the clusters of the places. Users and items with fewer than
    ``min_interactions`` observations in a cell do not take part in it. The number of cells is a parameter, so
    members are fitted one after another, each over the whole cluster.
    """

    defaults = {"how": "hmean", "fill": None, "n_unfiltered": 100, "n_lat": 3, "n_long": 3, "margin": 0.5, "min_interactions": 0, "n_clusters": None, "seed": 42}

    def __init__(self, make: Callable[[], Recommender], places: DataFrame, **params) -> None:
        super().__init__(**params)
        self.make, self.places = make, places

    def cells(self) -> DataFrame:
        """(itemid, cell); an item near a border is in several cells."""
        p = self.params
        if p["n_clusters"]:
            return mo.geo_clusters(self.places.dropna(subset=["lat", "long"]), p["n_clusters"], p["seed"]).select("itemid", F.col("cluster_label").alias("cell"))
        rows = cut(self.places.join(self.items, "itemid", "left_semi"), "places")
        return en.assign_cells(rows, en.equidense_grid(rows, p["n_lat"], p["n_long"], p["margin"])).select("itemid", "cell")

    def _fit(self) -> None:
        cells = cut(self.cells(), "cells")
        least = self.params["min_interactions"]
        self.members = []
        for r in sorted(r[0] for r in cells.select("cell").distinct().collect()):  # one row a cell
            own = self.train.join(ob.cluster_items(cells, int(r), "cell").select("itemid"), "itemid", "left_semi")
            if least:
                own = ob.sample_observations(cut(own, "cell"), min_user_hist=least, min_item_hist=least)
            self.members.append(self.make().fit(own))


def soft_votes(df: DataFrame, members: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """Adds ``probability``: the weighted mean of the members' probability columns."""
    total = float(sum(weights)) or 1.0
    return df.withColumn("probability", reduce(lambda a, b: a + b, [F.col(m) * (w / total) for m, w in zip(members, weights)]))


def voting_weights(df: DataFrame, label: str, members: Sequence[str], rounds: int = 10, cutoff: float | None = None) -> dict[str, float]:
    """Weights of the members' probability columns by forward selection on the log loss of 0/1 labels.

    Members whose own loss is over ``cutoff`` are left out. Each round one job scores every candidate at once.
    """
    clip = lambda p: F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    loss = lambda p: F.avg(-F.when(F.col(label) == 1, F.log(clip(p))).otherwise(F.log(1 - clip(p))))
    alone = df.agg(*[loss(F.col(m)).alias(m) for m in members]).first()
    left = [m for m in members if alone[m] is not None and (cutoff is None or alone[m] <= cutoff)]
    count, best = dict.fromkeys(left, 0), float("inf")
    for r in range(rounds if left else 0):
        sum_ = reduce(lambda a, b: a + b, [F.col(m) * float(c) for m, c in count.items()])
        tried = df.agg(*[loss((sum_ + F.col(m)) / float(r + 1)).alias(m) for m in left]).first()
        name = min(left, key=lambda m: tried[m])
        if tried[name] >= best:
            break
        count[name], best = count[name] + 1, tried[name]
    total = sum(count.values()) or 1
    return {m: c / total for m, c in count.items() if c}


def search_parameters(make: Callable[[dict], Recommender], train: DataFrame, valid: DataFrame, space: Mapping[str, Sequence], n: int = 20, metric: str = "auc", k: int = 10, random_share: float = 0.9, seed: int = 42) -> pd.DataFrame:
    """One row per trial, the best first: fits, evaluates on held-out data, loss = 1 - metric."""
    def loss(trial: dict) -> float:
        row = make(trial).fit(train).evaluate({"": valid}, k=k, include_train=False).first()
        return 1 - float(row[metric])

    return mo.guided_search(train.sparkSession, space, loss, n, random_share, seed)


def fit_with_early_stop(make: Callable[[int], Recommender], train: DataFrame, valid: DataFrame, metric: str = "auc", k: int = 10, **kw):
    """(best model, trail) over growing numbers of epochs; see early_stop."""
    return mo.early_stop(lambda e: make(e).fit(train), lambda m: float(m.evaluate({"": valid}, k=k, include_train=False).first()[metric]), **kw)
