"""All-pairs similarity of a bounded set of vectors against a table, and of sparse features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.rounding import half_up

BLOCK = 4_096
STRIPE = 512  # sources of a block that are scored at a time
DENSE = 1_024


def top_vectors(vectors: DataFrame, n: int, mode: str = "cosine", id_col: str = "id", vec_col: str = "vec", bias_col: str | None = None, sources: DataFrame | None = None, exclude: DataFrame | None = None, digits: int = 9, same_kind: bool = True, zeros: bool = True) -> DataFrame:
    """(source, target, prediction): the n most similar targets of each source, itself excluded.

    Both sides are cut into hashed blocks; each pair of blocks is one matrix product in one
    task, which hands on only the n best per source, so no pair of rows is materialised.
    Ties go by id. ``dot`` adds both biases; ``exclude`` holds (source, target) pairs, of which each
    source's list goes along with it to every block. Without ``same_kind`` equal ids of the two sides are
    different things; without ``zeros`` pairs whose score rounds to zero are none.
    """
    if mode not in ("cosine", "dot", "euclidean"):
        raise ValueError("mode must be 'cosine', 'dot' or 'euclidean'")
    bias = F.coalesce(F.col(bias_col).cast("double"), F.lit(0.0)) if bias_col else F.lit(0.0)
    pick = lambda df: df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), bias.alias("w")).filter("id is not null and size(v) > 0")
    targets, asked = pick(vectors), pick(sources if sources is not None else vectors)
    nt, ns = (max(1, -(-df.count() // BLOCK)) for df in (targets, asked))
    own = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    if exclude is not None:
        # At most as many ids as the source has pairs; they travel with its vector.
        held = exclude.toDF("id", "__q_t").groupBy("id").agg(F.collect_set("__q_t").alias("x"))
        asked = asked.join(held, "id", "left")
    else:
        asked = asked.withColumn("x", F.lit(None).cast("array<string>"))
    targets = targets.withColumn("x", F.lit(None).cast("array<string>"))
    left = asked.select(own(ns).alias("sb"), every(nt).alias("tb"), F.lit(0).alias("side"), "id", "v", "w", "x")
    right = targets.select(every(ns).alias("sb"), own(nt).alias("tb"), F.lit(1).alias("side"), "id", "v", "w", "x")
    width = n

    def best(cell: pd.DataFrame) -> pd.DataFrame:
        s, t = cell[cell.side == 0], cell[cell.side == 1]
        if not len(s) or not len(t):
            return pd.DataFrame({"source": pd.Series(dtype=object), "target": pd.Series(dtype=object), "prediction": pd.Series(dtype=float)})
        return pd.concat([stripe(s.iloc[i : i + STRIPE], t) for i in range(0, len(s), STRIPE)])

    def stripe(s: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        a, b = np.stack(s.v.to_numpy()), np.stack(t.v.to_numpy())
        score = a @ b.T
        if mode == "cosine":
            size = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
            score = np.divide(score, size, out=np.full_like(score, np.nan), where=size > 0)
        elif mode == "euclidean":
            score = 1 / (np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * score, 0)) + 0.001)
        else:
            score = score + s.w.to_numpy()[:, None] + t.w.to_numpy()
        score = half_up(score, digits)
        sid, tid = s.id.to_numpy(), t.id.to_numpy()
        rank = np.argsort(np.argsort(tid, kind="stable"), kind="stable")
        place = {t: j for j, t in enumerate(tid)}
        for r, (name, gone) in enumerate(zip(sid, s.x)):
            cols = [place[g] for g in (gone if gone is not None else ()) if g in place]
            if same_kind and name in place:
                cols.append(place[name])
            score[r, cols] = np.nan
        score = np.nan_to_num(score, nan=-np.inf)
        if not zeros:  # before places are given out
            score[score == 0] = -np.inf
        if width is None or width >= len(tid):
            rows, cols = np.nonzero(score > -np.inf)
        else:
            least = np.partition(score, len(tid) - width, axis=1)[:, len(tid) - width]
            rows, cols = np.nonzero((score >= least[:, None]) & (score > -np.inf))  # ties at the edge too
        order = np.lexsort((rank[cols], -score[rows, cols], rows))
        rows, cols = rows[order], cols[order]
        first = np.searchsorted(rows, rows)
        ok = np.arange(len(rows)) - first < (len(tid) if width is None else width)
        value = score[rows, cols]
        return pd.DataFrame({"source": sid[rows[ok]], "target": tid[cols[ok]], "prediction": value[ok]})

    found = left.unionByName(right).groupBy("sb", "tb").applyInPandas(best, "source string, target string, prediction double")
    w = Window.partitionBy("source").orderBy(F.col("prediction").desc(), F.col("target").asc())
    return found.withColumn("__q_r", F.row_number().over(w)).filter(F.col("__q_r") <= n).drop("__q_r")


def held_ranks(vectors: DataFrame, sources: DataFrame, held: DataFrame, exclude: DataFrame | None = None, id_col: str = "id", vec_col: str = "factors", bias_col: str = "bias", digits: int = 9) -> DataFrame:
    """(source, target, rank): the place, from 0, of each pair of ``held`` among all targets of its source by dot product and biases, ties by id.

    Pairs of blocks hand on how many targets come before each held one, so no list of scores leaves a task. Excluded
    pairs have no rank and count for none.
    """
    pick = lambda df: df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(F.col(bias_col).cast("double"), F.lit(0.0)).alias("w")).filter("id is not null and size(v) > 0")
    targets, asked = pick(vectors), pick(sources)
    pairs = held.toDF("id", "t").distinct()
    if exclude is not None:
        gone = exclude.toDF("id", "t")
        pairs = pairs.join(gone, ["id", "t"], "left_anti")
        gone = gone.groupBy("id").agg(F.collect_set("t").alias("x"))
    # A source's held targets come with their vectors, so that their scores are made as all others are.
    own = pairs.join(targets.select(F.col("id").alias("t"), F.col("v").alias("tv"), F.col("w").alias("tw")), "t").groupBy("id").agg(F.collect_list(F.struct("t", "tv", "tw")).alias("h"))
    asked = asked.join(own, "id").select("id", "v", "w", F.col("h.t").alias("h"), F.col("h.tv").alias("hv"), F.col("h.tw").alias("hw"))
    asked = asked.join(gone, "id", "left") if exclude is not None else asked.withColumn("x", F.lit(None).cast("array<string>"))
    nt, ns = (max(1, -(-df.count() // BLOCK)) for df in (targets, asked))
    block = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.select(block(ns).alias("sb"), every(nt).alias("tb"), F.lit(0).alias("side"), "id", "v", "w", "x", "h", "hv", "hw")
    right = targets.select(every(ns).alias("sb"), block(nt).alias("tb"), F.lit(1).alias("side"), "id", "v", "w")

    def before(cell: pd.DataFrame) -> pd.DataFrame:
        s, t = cell[cell.side == 0], cell[cell.side == 1]
        out: dict[str, list] = {"source": [], "target": [], "n": []}
        if len(s) and len(t):
            b, bias, tid = np.stack(t.v.to_numpy()), t.w.to_numpy(), t.id.to_numpy()
            order = np.argsort(tid, kind="stable")
            b, bias, tid = b[order], bias[order], tid[order]
            place = {x: j for j, x in enumerate(tid)}
            for name, v, w, gone, h, hv, hw in zip(s.id, s.v, s.w, s.x, s.h, s.hv, s.hw):
                score = half_up(b @ v + w + bias, digits)
                score[[place[g] for g in (gone if gone is not None else ()) if g in place]] = np.nan
                score[[place[g] for g in h if g in place]] = np.nan  # held ones are compared below, each with the same numbers
                mine = half_up(np.stack(hv) @ v + w + np.asarray(hw), digits)
                first = np.searchsorted(tid, np.asarray(h, dtype=object))
                n = [int((score > m).sum() + (score[:i] == m).sum()) for m, i in zip(mine, first)]
                inside = np.array([g in place for g in h])
                names = np.asarray(h, dtype=object)
                n = [k + int((inside & ((mine > m) | ((mine == m) & (names < g)))).sum()) for k, m, g in zip(n, mine, names)]
                out["source"] += [name] * len(n)
                out["target"] += list(h)
                out["n"] += n
        return pd.DataFrame(out).astype({"n": "int64"})

    found = left.unionByName(right, allowMissingColumns=True).groupBy("sb", "tb").applyInPandas(before, "source string, target string, n long")
    return found.groupBy("source", "target").agg(F.sum("n").alias("rank"))


def feature_similarity(features: DataFrame, n: int, digits: int = 9) -> DataFrame:
    """(source, target, prediction): cosine of sparse (itemid, feature, weight) rows, the n best per item.

    Pairs without a common feature, and those whose cosine rounds to zero, do not appear. Up to DENSE features
    the rows become dense vectors and go through top_vectors, more go through a join on the feature; both
    give the same rows.
    """
    rows = features.groupBy("itemid", "feature").agg(F.sum("weight").alias("weight")).filter("weight <> 0")
    names = [r[0] for r in rows.select("feature").distinct().limit(DENSE + 1).collect()]  # at most DENSE + 1
    if len(names) <= DENSE:
        code = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(sorted(names)) for x in (f, i)]), F.col("feature")) if names else F.lit(0)
        held = rows.groupBy("itemid").agg(F.map_from_entries(F.collect_list(F.struct(code.alias("k"), "weight"))).alias("m"))
        dense = F.transform(F.sequence(F.lit(0), F.lit(max(len(names) - 1, 0))), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
        return top_vectors(held.select(F.col("itemid").alias("id"), dense.alias("vec")), n, "cosine", digits=digits, zeros=False)
    size = rows.groupBy("itemid").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size")).filter("size > 0")
    unit = rows.join(size, "itemid").select("itemid", "feature", (F.col("weight") / F.col("size")).alias("u"))
    a, b = unit.toDF("source", "feature", "x"), unit.toDF("target", "feature", "y")
    pairs = a.join(b, "feature").filter("source <> target").groupBy("source", "target").agg(F.round(F.sum(F.col("x") * F.col("y")), digits).alias("prediction")).filter("prediction <> 0")
    w = Window.partitionBy("source").orderBy(F.col("prediction").desc(), F.col("target").asc())
    return pairs.withColumn("__q_r", F.row_number().over(w)).filter(F.col("__q_r") <= n).drop("__q_r")


def floor_shift(sim: DataFrame, score: str = "prediction", floor: float = 0.01) -> DataFrame:
    """If the smallest score lies below the floor, every score is raised by the difference."""
    low = F.broadcast(sim.agg(F.min(score).alias("__q_low")))  # one row
    raised = F.col(score) + F.when(F.col("__q_low") < floor, F.abs(F.col("__q_low") - floor)).otherwise(0.0)
    return sim.crossJoin(low).select(*[raised.alias(c) if c == score else c for c in sim.columns])
