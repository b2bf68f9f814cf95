"""Similarity clusters: Gaussian mixtures per segment, then an exact linking check.

Unit vectors are standardised and reduced (principal components) per segment; a
Gaussian mixture with regularised full covariances is fitted by EM over all rows,
each iteration one pass that returns sufficient statistics. Of several numbers of
components the Bayesian information criterion picks one. The members of highest
density represent a component.

The check then joins what a mixture tears apart and parts what it lumps together:
items whose cosine reaches the threshold belong together, directly or through
others. Members within half the threshold's angle of their component's direction
are certainly linked (the core); only pairs that angles to the other component's
direction leave open are compared, in blocks.

Segments are taken in hashed waves of about WAVE; models and statistics on the driver
and in the tasks are those of one wave, segments x components.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.splits import components
from quern.llm.top_items import top_n_per_group
from quern.llm.vectors import lists, matrix, unit, usable
from quern.scratch import cut, release

WAVE = 200  # segments fitted together; under 50 MB of models at 64 components
INIT_ROWS = 2_048  # rows of a segment that the first means are drawn from
BLOCK = 4_096


def by_segment(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    codes = batch.column("segment").dictionary_encode()
    own = codes.indices.to_numpy(zero_copy_only=False)
    for i, name in enumerate(codes.dictionary.to_pylist()):
        yield name, np.flatnonzero(own == i)


def moments(dim: int):
    """mapInArrow: (segment, vec) to each segment's count, sum and product sums in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            x = unit(matrix(batch.column("vec"), dim))
            for name, at in by_segment(batch):
                own = np.hstack([np.ones((len(at), 1)), x[at]])
                held[name] = held.get(name, 0) + own.T @ own
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([pickle.dumps(v) for v in held.values()], pa.binary())], names=["segment", "stats"])

    return run


def add_up(table: pa.Table) -> pa.Table:
    """applyInArrow: the sum of one segment's statistics."""
    total = None
    for raw in table.column("stats").to_pylist():
        part = pickle.loads(raw)
        if total is None:
            total = part
        elif isinstance(part, dict):
            for k, v in part.items():
                total[k] = merge_stat(total[k], v) if k in total else v
        else:
            total = total + part
    return pa.table({"segment": table.column("segment")[:1], "stats": pa.array([pickle.dumps(total)], pa.binary())})


def merge_stat(a, b):
    return tuple(x + y for x, y in zip(a, b))


def gathered(df: DataFrame) -> dict[str, object]:
    rows = df.groupBy("segment").applyInArrow(add_up, "segment string, stats binary").collect()  # one row a segment of the wave
    return {r[0]: pickle.loads(r[1]) for r in rows}


def projection(m: np.ndarray, reduced: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and matrix that standardise and reduce, from [1 x]'[1 x]."""
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    cov = m[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    _, vec = np.linalg.eigh(cov / np.outer(sd, sd))
    return mean, vec[:, ::-1][:, :reduced] / sd[:, None]


def projector(models: dict, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column("vec"), dim))
            y = np.empty((len(x), next(iter(models.values()))[1].shape[1]))
            for name, at in by_segment(batch):
                mean, w = models[name]
                y[at] = (x[at] - mean) @ w
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("segment"), lists(x), lists(y)], names=["id", "segment", "u", "y"])

    return run


def first_mixture(y: np.ndarray, k: int, rng: np.random.Generator) -> dict:
    """k-means++ and a few k-means steps; pooled covariance for every component."""
    k = min(k, len(y))
    at = [int(rng.integers(len(y)))]
    far = ((y - y[at[0]]) ** 2).sum(1)
    while len(at) < k:
        total = far.sum()
        at.append(int(rng.choice(len(y), p=far / total)) if total > 0 else int(rng.integers(len(y))))
        far = np.minimum(far, ((y - y[at[-1]]) ** 2).sum(1))
    mean = y[at].copy()
    for _ in range(8):
        own = np.argmin((mean * mean).sum(1) - 2 * y @ mean.T, axis=1)
        for j in np.unique(own):
            mean[j] = y[own == j].mean(0)
    spread = y - mean[own]
    d = y.shape[1]
    pooled = spread.T @ spread / len(y) + 1e-3 * np.eye(d) * max(float(y.var()), 1e-6)
    return {"weight": np.full(k, 1 / k), "mean": mean, "cov": np.repeat(pooled[None], k, 0)}


def prepared(mix: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverse factors of all covariances side by side, shifted means and constants of the log densities."""
    k, d = mix["mean"].shape
    low = np.linalg.cholesky(mix["cov"])
    inverse = np.linalg.inv(low)
    shift = np.einsum("kij,kj->ki", inverse, mix["mean"]).ravel()
    const = np.log(mix["weight"] + 1e-300) - 0.5 * d * np.log(2 * np.pi) - np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1)
    return inverse.transpose(2, 0, 1).reshape(d, k * d), shift, const


def log_density(y: np.ndarray, form: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """n x k: log weight + log normal density, one product for all components."""
    wide, shift, const = form
    z = y @ wide - shift
    return const - 0.5 * np.square(z, out=z).reshape(len(y), len(const), -1).sum(2)


def expectation(forms: dict, reduced: int):
    """mapInArrow: (segment, y) to each segment's sufficient statistics, for each candidate."""
    upper = np.triu_indices(reduced)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for batch in batches:
            y_all = matrix(batch.column("y"), reduced).astype(np.float64)
            for name, at in by_segment(batch):
                for s in range(0, len(at), 2048):
                    y = y_all[at[s : s + 2048]]
                    products = y[:, upper[0]] * y[:, upper[1]]
                    for cand, form in forms[name].items():
                        lp = log_density(y, form)
                        top = lp.max(axis=1, keepdims=True)
                        p = np.exp(lp - top)
                        total = p.sum(1, keepdims=True)
                        p /= total
                        stat = (p.sum(0), p.T @ y, p.T @ products, float((top + np.log(total)).sum()), len(y))
                        own = held.setdefault(name, {})
                        own[cand] = merge_stat(own[cand], stat) if cand in own else stat
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([pickle.dumps(v) for v in held.values()], pa.binary())], names=["segment", "stats"])

    return run


def maximisation(stat: tuple) -> dict:
    """New mixture; each covariance is shrunk towards the pooled one and kept off zero."""
    count, sums, flat, _, n = stat
    d = sums.shape[1]
    squares = np.empty((len(count), d, d))
    i, j = np.triu_indices(d)
    squares[:, i, j] = squares[:, j, i] = flat
    mean = sums / np.maximum(count, 1e-9)[:, None]
    cov = squares / np.maximum(count, 1e-9)[:, None, None] - np.einsum("ki,kj->kij", mean, mean)
    pooled = np.einsum("k,kij->ij", count / n, cov)
    pooled += 1e-4 * np.eye(d) * max(np.trace(pooled) / d, 1e-6)
    prior = d + 2.0
    cov = (count[:, None, None] * cov + prior * pooled) / (count + prior)[:, None, None]
    return {"weight": count / n, "mean": mean, "cov": (cov + cov.transpose(0, 2, 1)) / 2}


def bic(stat: tuple, reduced: int) -> float:
    k = len(stat[0])
    free = k * (1 + reduced + reduced * (reduced + 1) / 2) - 1
    return free * np.log(max(stat[4], 2)) - 2 * stat[3]


def assigner(forms: dict, reduced: int):
    """mapInArrow: most probable component and log density under it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = matrix(batch.column("y"), reduced).astype(np.float64)
            own, dens = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for name, at_all in by_segment(batch):
                form, log_weight = forms[name]
                for s in range(0, len(at_all), 2048):
                    at = at_all[s : s + 2048]
                    lp = log_density(y[at], form)
                    own[at] = lp.argmax(1)
                    dens[at] = lp.max(1) - log_weight[own[at]]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("segment"), batch.column("u"), pa.array(own), pa.array(dens)], names=["id", "segment", "u", "comp", "density"])

    return run


def mixture_clusters(items: DataFrame, counts: DataFrame, dim: int = 64, reduced: int = 16, rounds: int = 12, candidates: Sequence[float] = (0.75, 1.0, 1.35), seed: int = 7) -> DataFrame:
    """(id, segment, u, comp, density): every usable item's mixture component and log density.

    ``items`` is (id, segment, vec) of usable vectors, ``counts`` (segment, n_clusters), both of one wave
    of segments; the numbers of components tried are n_clusters times ``candidates``, and the information
    criterion picks one per segment. Items of a null segment or one without a count are left out. A
    component may end up empty.
    """
    counts = counts.toDF("segment", "k").filter("segment is not null and k > 0").groupBy("segment").agg(F.max("k").alias("k"))
    here = cut(items.select("id", "segment", "vec").join(counts, "segment").select("id", "segment", "vec"), "items")
    sizes = {r[0]: (r[1], r[2]) for r in here.groupBy("segment").count().join(counts, "segment").collect()}  # one row a segment of the wave
    names = sorted(sizes)
    models = {k: projection(m, reduced) for k, m in gathered(here.select("segment", "vec").mapInArrow(moments(dim), "segment string, stats binary")).items()}
    parts = int(here.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    feats = here.repartitionByRange(parts, "segment", F.xxhash64("id")).mapInArrow(projector(models, dim), "id string, segment string, u array<float>, y array<float>")
    feats = cut(feats, "features")
    release(here)
    share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1_000_000, int(1e6 * INIT_ROWS / sizes[k][0]) + 1))]) if names else F.create_map(F.lit(""), F.lit(0))
    drawn = feats.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < F.element_at(share, F.col("segment"))).select("segment", "y").toArrow()
    rng = np.random.default_rng(seed)
    mixtures: dict[str, dict] = {}
    if drawn.num_rows:
        y0 = matrix(drawn.column("y").combine_chunks(), reduced).astype(np.float64)
        seg = np.array(drawn.column("segment").to_pylist(), dtype=object)
        for k in names:
            mixtures[k] = {c: first_mixture(y0[seg == k], max(1, round(sizes[k][1] * c)), rng) for c in candidates}
    stats, last = {}, -np.inf
    for _ in range(rounds if names else 0):
        forms = {k: {c: prepared(m) for c, m in v.items()} for k, v in mixtures.items()}
        stats = gathered(feats.select("segment", "y").mapInArrow(expectation(forms, reduced), "segment string, stats binary"))
        mixtures = {k: {c: maximisation(s) for c, s in v.items()} for k, v in stats.items()}
        now = sum(s[3] for v in stats.values() for s in v.values())
        if now - last < 1e-4 * abs(now):
            break
        last = now
    best = {k: mixtures[k][min(v, key=lambda c: bic(v[c], reduced))] for k, v in stats.items()}
    forms = {k: (prepared(m), np.log(m["weight"] + 1e-300)) for k, m in best.items()}
    placed = cut(feats.mapInArrow(assigner(forms, reduced), "id string, segment string, u array<float>, comp int, density double"), "placed")
    release(feats)
    return placed


def directions(dim: int):
    """mapInArrow: each (segment, comp)'s vector sum and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for batch in batches:
            u = matrix(batch.column("u"), dim).astype(np.float64)
            comp = batch.column("comp").to_numpy()
            for name, at in by_segment(batch):
                own = held.setdefault(name, {})
                for c in np.unique(comp[at]):
                    rows = u[at[comp[at] == c]]
                    stat = (rows.sum(0), len(rows))
                    own[int(c)] = merge_stat(own[int(c)], stat) if int(c) in own else stat
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([pickle.dumps(v) for v in held.values()], pa.binary())], names=["segment", "stats"])

    return run


KINDS = {"cores": 0, "loose to core": 1, "loose": 2}


def _repeat(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row i n[i] times, with a running number within the row."""
    return np.repeat(np.arange(len(n)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def router(models: dict, dim: int, theta: float):
    """mapInArrow: items to the cells in which they are compared.

    models[segment] = (directions, blocks of each component, blocks of loose items). Cells, by kind: 0, the
    cores of components lo and hi; 1, the core of lo and loose items; 2, loose items of the segment. A row
    of a cell has side 0 or 1 and meets every block of the other side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = matrix(batch.column("u"), dim).astype(np.float64)
            comp = batch.column("comp").to_numpy()
            spot = batch.column("spot").to_numpy(zero_copy_only=False)
            out: list[np.ndarray] = []  # columns row, kind, lo, hi, side, b0, b1

            def add(row, kind, lo, hi, side, b0, b1) -> None:
                if len(row):
                    out.append(np.stack([np.broadcast_to(np.asarray(c, np.int64), row.shape) for c in (row, kind, lo, hi, side, b0, b1)]))

            for name, at in by_segment(batch):
                centre, blocks, loose_blocks = models[name]
                own = comp[at]
                angle = np.arccos(np.clip(u[at] @ centre.T, -1, 1))
                core = angle[np.arange(len(at)), own] <= theta / 2
                # Every core angle is at most theta / 2.
                open_ = (angle <= 1.5 * theta + 1e-9) & (blocks > 0)
                mine = np.where(core, spot[at] % blocks[own], spot[at] % loose_blocks)
                others = open_ & core[:, None]
                others[np.arange(len(at)), own] = False
                i, c = np.nonzero(others)
                k, b = _repeat(blocks[c])
                i, c = i[k], c[k]
                low = own[i] < c
                add(at[i], 0, np.minimum(own[i], c), np.maximum(own[i], c), ~low, np.where(low, mine[i], b), np.where(low, b, mine[i]))
                cores, loose = np.flatnonzero(core), np.flatnonzero(~core)
                k, b = _repeat(np.full(len(cores), loose_blocks))
                i = cores[k]
                add(at[i], 1, own[i], -1, 0, mine[i], b)
                i, c = np.nonzero(open_ & ~core[:, None])
                k, b = _repeat(blocks[c])
                i, c = i[k], c[k]
                add(at[i], 1, c, -1, 1, b, mine[i])
                k, b = _repeat(np.full(len(loose), loose_blocks))
                i = loose[k]
                add(at[i], 2, -1, -1, 0, mine[i], b)
                add(at[i], 2, -1, -1, 1, b, mine[i])
            if out:
                rows = np.concatenate(out, axis=1)
                for s in range(0, rows.shape[1], 10_000):
                    part = rows[:, s : s + 10_000]
                    take = pa.array(part[0])
                    cols = [batch.column("segment").take(take), *[pa.array(part[j].astype(np.int32)) for j in range(1, 7)], batch.column("id").take(take), batch.column("u").take(take)]
                    yield pa.RecordBatch.from_arrays(cols, names=["segment", "kind", "lo", "hi", "side", "b0", "b1", "id", "u"])

    return run


def linker(dim: int, least: float):
    """applyInArrow over one cell: enough links to connect what is linked in it."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        x = matrix(table.column("u").combine_chunks(), dim).astype(np.float64)
        kind, lo, hi, seg = (table.column(c)[0].as_py() for c in ("kind", "lo", "hi", "segment"))
        core = lambda c: f"c|{c}|{seg}"
        loose = lambda rows: ["i|" + seg + "|" + i for i in table.column("id").take(pa.array(rows)).to_pylist()]
        p, m = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        hit = np.zeros(len(m), bool)
        edges: list[np.ndarray] = []
        for s in range(0, len(p) if len(m) else 0, 1024):
            score = x[p[s : s + 1024]] @ x[m].T >= least
            if kind < 2:
                hit |= score.any(axis=0)
                if kind == 0 and hit.any():
                    break
            else:
                i, j = np.nonzero(score)
                first = score.argmax(axis=1)
                # a row's linked columns all lead to its first one
                edges.append(np.unique(np.stack([m[first[i]], m[j]]), axis=1))
                some = np.flatnonzero(score.any(axis=1))
                edges.append(np.stack([p[s + some], m[first[some]]]))
        if kind == 0:
            a, b = ([core(lo)], [core(hi)]) if hit.any() else ([], [])
        elif kind == 1:
            b = loose(m[hit])
            a = [core(lo)] * len(b)
        else:
            both = np.unique(np.concatenate(edges, axis=1), axis=1) if edges else np.empty((2, 0), np.int64)
            a, b = loose(both[0]), loose(both[1])
            a, b = [v for v, w in zip(a, b) if v != w], [w for v, w in zip(a, b) if v != w]
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return run


def core_marks(models: dict, dim: int, theta: float):
    """mapInArrow: adds whether an item lies in the core of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = matrix(batch.column("u"), dim).astype(np.float64)
            comp = batch.column("comp").to_numpy()
            core = np.zeros(batch.num_rows, bool)
            for name, at in by_segment(batch):
                core[at] = np.arccos(np.clip((u[at] * models[name][0][comp[at]]).sum(1), -1, 1)) <= theta / 2
            yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("id"), batch.column("density"), batch.column("comp"), pa.array(core)], names=["segment", "id", "density", "comp", "core"])

    return run


def linked_groups(placed: DataFrame, least: float = 0.6, dim: int = 64) -> DataFrame:
    """(segment, id, density, grp): groups of items linked at cosine ``least``, directly or through others.

    ``placed`` comes from mixture_clusters. The result does not depend on the mixture,
    only the number of compared pairs does. Items linked to nobody are groups of one; an id
    with several vectors is linked by any of them and has the highest density of them.
    """
    theta = float(np.arccos(least))
    sums = gathered(placed.select("segment", "u", "comp").mapInArrow(directions(dim), "segment string, stats binary"))
    models = {}
    for k in sorted(sums):
        size = max(sums[k]) + 1
        centre, n = np.zeros((size, dim)), np.zeros(size, np.int64)
        for c, (total, count) in sums[k].items():
            centre[c], n[c] = total / max(np.linalg.norm(total), 1e-12), count
        models[k] = (centre, -(-n // BLOCK), int(-(-n.sum() // (8 * BLOCK))))
    marked = placed.withColumn("spot", F.shiftrightunsigned(F.xxhash64("id"), 1))
    rows = marked.mapInArrow(router(models, dim, theta), "segment string, kind int, lo int, hi int, side int, b0 int, b1 int, id string, u array<float>")
    found = rows.groupBy("segment", "kind", "lo", "hi", "b0", "b1").applyInArrow(linker(dim, least), "a string, b string")
    own = placed.mapInArrow(core_marks(models, dim, theta), "segment string, id string, density double, comp int, core boolean")
    node = F.when(F.col("core"), F.concat_ws("|", F.lit("c"), "comp", "segment")).otherwise(F.concat_ws("|", F.lit("i"), "segment", "id"))
    own = cut(own.select("segment", "id", "density", node.alias("node")), "nodes")
    several = own.groupBy("segment", "id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("segment", "id", "a")
    same = own.join(several, ["segment", "id"]).filter("a <> node").select("a", F.col("node").alias("b"))
    edges = cut(found.distinct().unionByName(same), "links")
    comps = components(edges)
    grp = own.join(comps, "node", "left").select("segment", "id", "density", F.coalesce("component", "node").alias("grp"))
    return grp.groupBy("segment", "id").agg(F.max("density").alias("density"), F.min("grp").alias("grp"))


def item_groups(items: DataFrame, counts: DataFrame, least: float = 0.6, smallest: int = 3) -> DataFrame:
    """(segment, grp, id, density, first, size) of the groups with at least ``smallest`` items."""
    vectors = usable(items, "itemid", "item_embeddings", 64, "segment").distinct()
    counts = counts.select("segment", "n_clusters")
    waves = max(1, -(-counts.select("segment").distinct().count() // WAVE))
    own = lambda df, w: df.filter(F.pmod(F.xxhash64("segment"), F.lit(waves)) == w) if waves > 1 else df
    found = [cut(linked_groups(mixture_clusters(own(vectors, w), own(counts, w)), least), "groups") for w in range(waves)]
    groups = reduce(DataFrame.unionByName, found)
    sizes = groups.groupBy("grp").agg(F.min("id").alias("first"), F.count("*").alias("size")).filter(F.col("size") >= smallest)
    return groups.join(sizes, "grp")


def typical_items(groups: DataFrame, n: int = 3) -> DataFrame:
    """(segment, first, size, place, itemid, density): each group's size and members of highest density."""
    top = top_n_per_group(groups, ["grp"], [F.col("density").desc(), F.col("id").asc()], n, out="place")
    return top.select("segment", "first", "size", "place", F.col("id").alias("itemid"), "density")
