"""Trained recommenders: thin layers over pyspark.ml, and a pairwise-ranking factoriser.

Factor tables are (id string, bias double, factors array<float>).
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.hashing import hashed
from quern.functions.vectors import dot, similarity
from quern.operators.features import encode_labels
from quern.scratch import cut, release

FACTOR_BYTES = 256 << 20


def bm25(obs: DataFrame, k1: float = 100.0, b: float = 0.15) -> DataFrame:
    """Ratings as BM25 weights of items over users; three small aggregates joined back."""
    rows = obs.groupBy("itemid", "userid").agg(F.sum("rating").alias("rating"))
    size = rows.groupBy("itemid").agg(F.sum("rating").alias("len"))
    users = rows.groupBy("userid").agg(F.count("*").alias("df"))
    all_ = F.broadcast(size.agg(F.count("*").alias("n"), F.avg("len").alias("mean")))  # one row
    idf = F.log(F.col("n")) - F.log1p(F.col("df"))
    scale = k1 * (1 - b + b * F.col("len") / F.nullif(F.col("mean"), F.lit(0.0)))
    return rows.join(size, "itemid").join(users, "userid").crossJoin(all_).select("userid", "itemid", (F.col("rating") * (k1 + 1) / (scale + F.col("rating")) * idf).alias("rating"))


def als_factors(obs: DataFrame, rank: int = 32, iterations: int = 5, reg: float = 0.1, seed: int = 42, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """User and item factor tables of implicit ALS over (optionally) BM25 weights."""
    rows = bm25(obs).filter("rating > 0") if weighted else obs
    users, items = (cut(encode_labels(rows, c), "codes") for c in ("userid", "itemid"))
    coded = rows.join(users.toDF("userid", "u"), "userid").join(items.toDF("itemid", "i"), "itemid")
    model = ALS(userCol="u", itemCol="i", ratingCol="rating", rank=rank, maxIter=iterations, regParam=reg, implicitPrefs=True, seed=seed).fit(coded.select(F.col("u").cast("int"), F.col("i").cast("int"), F.col("rating").cast("float")))
    named = lambda f, codes: f.join(codes, F.col("id") == F.col("code")).select(F.col("value").alias("id"), F.lit(None).cast("double").alias("bias"), F.col("features").alias("factors"))
    return named(model.userFactors, users), named(model.itemFactors, items)


NEGATIVES = 10


def _preferences(loss: str, seen: np.ndarray, u: np.ndarray, v: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A negative item and a gradient for each of a user's items.

    'bpr': one drawn item, the logistic gradient. 'warp': the first of NEGATIVES drawn ones that comes within 1 of
    the positive, weighted by the rank that the number of draws suggests. 'hinge': the best scored of NEGATIVES.
    """
    pos = v[seen] @ u + b[seen]
    if loss == "bpr":
        j = rng.integers(0, len(v), len(seen))
        return j, 1 / (1 + np.exp(np.clip(pos - v[j] @ u - b[j], -30, 30)))
    drawn = rng.integers(0, len(v), (len(seen), NEGATIVES))
    neg = v[drawn] @ u + b[drawn]
    if loss == "warp":
        near = neg > pos[:, None] - 1
        first = near.argmax(axis=1)
        weight = np.log1p((len(v) - 1) // (first + 1)) / np.log1p(len(v))
        return drawn[np.arange(len(seen)), first], np.where(near.any(axis=1), weight, 0.0)
    best = neg.argmax(axis=1)
    return drawn[np.arange(len(seen)), best], (neg.max(axis=1) - pos + 1 > 0).astype(float)


def bpr_factors(obs: DataFrame, rank: int = 16, epochs: int = 10, rate: float = 0.05, reg: float = 0.01, seed: int = 42, loss: str = "bpr", start: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Factors and item biases by pairwise ranking: SGD inside user blocks, items averaged per epoch.

    ``loss`` is 'bpr', 'warp' or 'hinge'; a user's items are one step. Items known from ``start`` (item
    factors of earlier batches) begin there. Item factors go to every task and must stay under 256 MB (checked); user factors stay
    with their block.
    """
    spark = obs.sparkSession
    if loss not in ("bpr", "warp", "hinge"):
        raise ValueError("loss must be 'bpr', 'warp' or 'hinge'")
    items = cut(encode_labels(obs, "itemid"), "items")
    n = items.count()
    if n * (rank + 1) * 8 > FACTOR_BYTES:
        raise ValueError("item factors too large for block-wise SGD; use als_factors")
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hist = obs.join(items.toDF("itemid", "i"), "itemid").groupBy("userid").agg(F.sort_array(F.collect_set(F.col("i").cast("int"))).alias("seen"))
    hist = cut(hist.repartition(blocks, "userid").sortWithinPartitions("userid"), "histories")
    rng = np.random.default_rng(seed)
    v, bias = rng.normal(0, 0.1, (n, rank)), np.zeros(n)

    if start is not None:
        for r in start.join(items, F.col("id") == F.col("value")).select("code", "bias", "factors").collect():  # n checked above
            v[r.code], bias[r.code] = r.factors, r.bias or 0.0

    def epoch(number: int, v0: np.ndarray, b0: np.ndarray, last: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            v, b = v0.copy(), b0.copy()
            done = 0
            for f in frames:
                for name, seen in zip(f.userid, f.seen):
                    own = np.random.default_rng(abs(hash((seed, number, len(seen), int(seen[0])))) % 2**32)
                    u = np.zeros(rank) + v[seen].mean(0)
                    seen = np.asarray(seen)
                    for _ in range(1 if not last else 3):
                        j, g = _preferences(loss, seen, u, v, b, own)
                        gap = v[seen] - v[j]
                        step = u.copy()
                        u = u + rate * ((g[:, None] * gap).sum(0) - reg * len(seen) * u)
                        np.add.at(v, seen, rate * (g[:, None] * step - reg * v[seen]))
                        np.add.at(v, j, rate * (-g[:, None] * step - reg * v[j]))
                        np.add.at(b, seen, rate * (g - reg * b[seen]))
                        np.add.at(b, j, rate * (-g - reg * b[j]))
                    done += len(seen)
                    if last:
                        yield pd.DataFrame({"id": [name], "bias": [0.0], "factors": [u.tolist()]})
            if not last and done:
                yield pd.DataFrame({"id": [str(done)], "bias": [0.0], "factors": [np.column_stack([v, b]).ravel().tolist()]})

        return run

    kind = "id string, bias double, factors array<float>"
    for e in range(epochs):
        parts = hist.mapInPandas(epoch(e, v, bias, False), kind).toLocalIterator()  # one item table a block
        total, weight = np.zeros((n, rank + 1)), 0
        for p in parts:
            total += int(p.id) * np.array(p.factors).reshape(n, rank + 1)
            weight += int(p.id)
        if weight:
            v, bias = total[:, :rank] / weight, total[:, rank] / weight
    users = cut(hist.mapInPandas(epoch(epochs, v, bias, True), kind), "users")
    local = items.select("value", "code").collect()  # n checked above
    rows = [(r.value, float(bias[r.code]), [float(x) for x in v[r.code]]) for r in local]
    release(hist)
    return users, spark.createDataFrame(rows, kind)


def sequences(obs: DataFrame, ts: str = "ts", longest: int = 200) -> DataFrame:
    """(userid, items): each user's latest items in order of time."""
    last = F.slice(F.sort_array(F.collect_list(F.struct(F.col(ts), "itemid")), asc=False), 1, longest)
    return obs.groupBy("userid").agg(last.alias("s")).select("userid", F.reverse(F.transform("s", lambda x: x["itemid"])).alias("items"))


def pooled_scores(seqs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, bias, factors) of users as the mean of their items' factors."""
    rows = seqs.select("userid", F.explode("items").alias("id")).join(items, "id").select("userid", F.posexplode("factors"))
    means = rows.groupBy("userid", "pos").agg(F.avg("col").alias("m"))
    return means.groupBy("userid").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("f")).select(F.col("userid").alias("id"), F.lit(None).cast("double").alias("bias"), F.transform("f", lambda x: x["m"].cast("float")).alias("factors"))


def cluster_factors(users: DataFrame, items: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """((side, id, cluster), (cluster, other, cosine)): k-means over both sides' unit factors, and centres by nearness."""
    both = users.select(F.lit("user").alias("side"), "id", "factors").unionByName(items.select(F.lit("item").alias("side"), "id", "factors"))
    unit = Normalizer(inputCol="v", outputCol="u").transform(both.withColumn("v", array_to_vector(F.col("factors").cast("array<double>"))))
    model = KMeans(k=k, seed=seed, featuresCol="u", predictionCol="cluster").fit(unit)
    centres = users.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, c array<double>")
    other = centres.toDF("other", "d")
    near = centres.crossJoin(other).select("cluster", "other", similarity(F.col("c"), F.col("d"), "cosine").alias("cosine"))  # k x k
    return model.transform(unit).select("side", "id", "cluster"), near


def cluster_candidates(members: DataFrame, near: DataFrame, k: int, ratio: float) -> DataFrame:
    """(userid, itemid): items of the user's own cluster and of the nearest ceil(ratio * k) other clusters."""
    from pyspark.sql import Window

    n = max(1, -int(-(ratio * k) // 1))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy((F.col("cluster") == F.col("other")).desc(), F.col("cosine").desc(), "other"))
    close = near.withColumn("r", rank).filter(F.col("r") <= n + 1).select("cluster", "other")
    users = members.filter("side = 'user'").select(F.col("id").alias("userid"), "cluster")
    items = members.filter("side = 'item'").select(F.col("id").alias("itemid"), F.col("cluster").alias("other"))
    return users.join(F.broadcast(close), "cluster").join(items, "other").select("userid", "itemid")


def geo_clusters(places: DataFrame, k: int = 20, seed: int = 42) -> DataFrame:
    rows = VectorAssembler(inputCols=["lat", "long"], outputCol="v").transform(places)
    return KMeans(k=k, seed=seed, featuresCol="v", predictionCol="cluster_label").fit(rows).transform(rows).drop("v")


def negatives(obs: DataFrame, seed: int = 42) -> DataFrame:
    """Positives (rating 1) with as many random re-pairings of users and items (rating 0)."""
    from quern.operators.positions import with_positions

    users = with_positions(obs.select("userid", "itemid"), [], [F.col("userid").asc(), F.col("itemid").asc()], out="p").select("userid", "p")
    items = with_positions(obs.select("userid", "itemid"), [], [hashed("userid", "itemid", seed=seed).asc(), F.col("itemid").asc()], out="p").select("itemid", "p")
    return obs.select("userid", "itemid", F.lit(1.0).alias("rating")).unionByName(users.join(items, "p").select("userid", "itemid", F.lit(0.0).alias("rating")))


def rerank_regressor(pairs: DataFrame, users: DataFrame, items: DataFrame, kind: str = "forest", target: str = "rating", seed: int = 42, **kw):
    """(model, transform): a regressor over both sides' factors and their product."""
    def frame(df: DataFrame) -> DataFrame:
        u = users.select(F.col("id").alias("userid"), F.col("factors").alias("uf"))
        i = items.select(F.col("id").alias("itemid"), F.col("factors").alias("vf"))
        joined = df.join(u, "userid").join(i, "itemid").withColumn("fact", dot(F.col("uf"), F.col("vf")))
        vec = array_to_vector(F.concat(F.col("uf").cast("array<double>"), F.col("vf").cast("array<double>"), F.array("fact")))
        return joined.withColumn("features", vec).drop("uf", "vf")

    cls = {"forest": RandomForestRegressor, "boosted": GBTRegressor}[kind]
    model = cls(featuresCol="features", labelCol=target, seed=seed, **kw).fit(frame(pairs))
    return model, lambda df: model.transform(frame(df)).drop("features", "fact")


def r2(df: DataFrame, target: str = "rating") -> float:
    return RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="r2").evaluate(df)


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, precision, recall, f1, support)."""
    hit = F.col(label) == F.col(prediction)
    rec = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("support"), F.count_if(hit).alias("hit"))
    pre = df.groupBy(F.col(prediction).alias("label")).agg(F.count("*").alias("said"))
    j = rec.join(pre, "label", "left").select("label", (F.col("hit") / F.nullif(F.col("said"), F.lit(0))).alias("precision"), (F.col("hit") / F.col("support")).alias("recall"), "support")
    j = j.withColumn("precision", F.coalesce("precision", F.lit(0.0)))
    return j.select("label", "precision", "recall", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0)).alias("f1"), "support")


def early_stop(step: Callable[[int], object], score: Callable[[object], float], max_epochs: int = 200, step_epochs: int = 10, patience: int = 10, decline: float = 0.05) -> tuple[object, list[tuple[int, float]]]:
    """Train on in steps, keep the best; stop after ``patience`` epochs more than ``decline`` below it."""
    best, top, bad, trail, at = None, -np.inf, 0, [], 0
    while at < max_epochs and bad < patience:
        at += step_epochs
        model = step(at)
        now = score(model)
        trail.append((at, now))
        if now > top:
            best, top, bad = model, now, 0
        elif top > 0 and (top - now) / top > decline:
            bad += step_epochs
    return best, trail


def _trial(objective: Callable[[dict], float], trial: dict) -> dict:
    import time

    begun = time.time()
    try:
        loss = float(objective(trial))
    except Exception:  # a failed trial is the worst one
        loss = 1.0
    return trial | {"target_loss": loss, "time_taken": time.time() - begun}


def random_search(space: Mapping[str, Sequence], objective: Callable[[dict], float], n: int = 20, seed: int = 42) -> pd.DataFrame:
    """One row per trial: parameters, loss (1 for a failed trial) and seconds, the best first."""
    rng = random.Random(seed)
    rows = [_trial(objective, {k: rng.choice(list(v)) for k, v in space.items()}) for _ in range(n)]
    return pd.DataFrame(rows).sort_values("target_loss", kind="stable").reset_index(drop=True)


def guided_search(spark, space: Mapping[str, Sequence], objective: Callable[[dict], float], n: int = 20, random_share: float = 0.9, seed: int = 42, pool: int = 200) -> pd.DataFrame:
    """Random trials first, then those of the greatest expected improvement under a forest fitted to the trials so far."""
    from math import erf, exp, pi, sqrt

    rng = random.Random(seed)
    draw = lambda: {k: rng.choice(list(v)) for k, v in space.items()}
    place = lambda t: [float(list(space[k]).index(t[k])) for k in space]
    rows: list[dict] = []
    for i in range(n):
        if i < max(2, int(n * random_share)):
            trial = draw()
        else:
            known = spark.createDataFrame([(place(r), float(r["target_loss"])) for r in rows], "x array<double>, label double").withColumn("features", array_to_vector("x"))
            forest = RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed).fit(known)
            tried = [draw() for _ in range(pool)]
            asked = spark.createDataFrame([(j, place(t)) for j, t in enumerate(tried)], "j int, x array<double>").withColumn("features", array_to_vector("x"))
            votes = np.zeros((len(forest.trees), pool))
            for t, tree in enumerate(forest.trees):
                for r in tree.transform(asked).select("j", "prediction").collect():  # the pool
                    votes[t, r.j] = r.prediction
            best = min(r["target_loss"] for r in rows)
            mean, sd = votes.mean(0), np.maximum(votes.std(0), 1e-9)
            z = (best - mean) / sd
            gain = [s * (a * (1 + erf(a / sqrt(2))) / 2 + exp(-a * a / 2) / sqrt(2 * pi)) for a, s in zip(z, sd)]
            trial = tried[int(np.argmax(gain))]
        rows.append(_trial(objective, trial))
    return pd.DataFrame(rows).sort_values("target_loss", kind="stable").reset_index(drop=True)


def best_ranks(test: DataFrame, seed: int = 42) -> DataFrame:
    """(.., rank): a user's test items in drawn order from rank 0 on, the best that any ranking can do."""
    from pyspark.sql import Window

    return test.withColumn("rank", (F.row_number().over(Window.partitionBy("userid").orderBy(hashed("userid", "itemid", seed=seed), "itemid")) - 1).cast("bigint"))


def chance_ranks(test: DataFrame, n_items: int, seed: int = 42) -> DataFrame:
    """(.., rank): different ranks below n_items for a user's test items, spread evenly from a drawn start."""
    from math import gcd

    stride = max(1, int(0.618 * n_items))
    while gcd(stride, n_items) != 1:
        stride += 1
    start = F.pmod(hashed("userid", seed=seed), F.lit(n_items))
    return best_ranks(test, seed).withColumn("rank", F.pmod(start + F.col("rank") * stride, F.lit(n_items)))
