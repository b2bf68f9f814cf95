"""Most similar vectors: balanced posting lists searched through a centroid graph.

Centroids are fitted on a bounded sample and balanced by splitting large clusters;
every vector is indexed. A graph over the centroids, small enough to send to each
executor, finds the lists near a vector. Vectors near a border are replicated to the
lists whose centroids lie within a distance ratio of the nearest one's, at most MOST;
a probe searches the lists within a larger ratio, at most PROBES. Long lists are cut
into blocks, so a task holds at most two blocks whatever the skew.

The number of lists grows with the table up to MAX_LISTS (4 million vectors); beyond
that the lists grow instead, and with them the work per vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.hashing import hashed
from quern.llm.vectors import lists, matrix, unit, usable, vector_key
from quern.operators.similarity import top_vectors
from quern.scratch import cut

SAMPLE = 50_000  # vectors the centroids are fitted on, or PER_LIST a list where that is more
PER_LIST = 4
LIST_SIZE = 128  # vectors aimed at in a list
MAX_LISTS = 32_768  # centroids and their graph stay under 12 MB at 64 dimensions
RATIO, MOST = 0.05, 4  # of the lists that hold a vector
PROBE_RATIO, PROBES = 0.2, 16  # of the lists that a probe for its nearest vectors searches
BLOCK = 4_096  # vectors of a list compared in one task
DEGREE = 16
BEAM = 32
WIDE = 20  # the nearest candidates that are expanded in any case
MEMBER, PROBE = 1, 2


@dataclass
class Graph:
    """Centroids, their neighbour lists and entry points."""

    centre: np.ndarray
    edges: np.ndarray
    entries: np.ndarray


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid, by blocks."""
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def balanced_centroids(x: np.ndarray, k: int, seed: int = 7, rounds: int = 6) -> np.ndarray:
    """k-means whose clusters above twice the mean size are split and whose rarest give way."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for step in range(rounds):
        own = nearest(x, c)
        size = np.bincount(own, minlength=k)
        sums = np.zeros((k, x.shape[1]))
        np.add.at(sums, own, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c).astype(np.float32)
        if step < rounds - 1:
            big = np.argsort(-size)[: k // 4]
            big = big[size[big] > 2 * len(x) / k]
            rare = np.argsort(size)[: len(big)]
            rare = rare[size[rare] < len(x) / k / 2]
            for b, r in zip(big, rare):
                c[r] = x[rng.choice(np.flatnonzero(own == b))]
    return c


def centroid_graph(c: np.ndarray, seed: int = 7) -> Graph:
    """Edges to near centroids in different directions, two random ones, and spread entries.

    A neighbour that lies closer to one already chosen is passed over, so edges lead
    out of a dense knot of centroids; entries are chosen farthest first.
    """
    rng = np.random.default_rng(seed)
    c = c.astype(np.float32)
    k = len(c)
    half = (c * c).sum(1) / 2
    width = min(DEGREE, max(k - 1, 1))
    edges = np.empty((k, width), np.int32)
    for i in range(k):
        score = half - c @ c[i]
        score[i] = np.inf
        near = np.argpartition(score, min(4 * DEGREE, k - 1))[: 4 * DEGREE] if k > 4 * DEGREE else np.arange(k)
        near = near[np.argsort(score[near])]
        near = near[near != i] if k > 1 else near
        away = ((c[near] - c[i]) ** 2).sum(1)
        between = ((c[near][:, None] - c[near][None]) ** 2).sum(2)
        kept: list[int] = []
        for j in range(len(near)):
            if len(kept) < width - 2 and not (kept and (between[j, kept] < away[j]).any()):
                kept.append(j)
        rest = [j for j in range(len(near)) if j not in set(kept)]
        row = near[kept + rest][:width]
        edges[i, : len(row)] = row
        edges[i, len(row) :] = row[-1]
    if k > DEGREE + 2:
        edges[:, -2:] = rng.integers(0, k, (k, 2))
    count = min(k, max(2 * BEAM, int(6 * np.sqrt(k))))
    entries = [int(rng.integers(k))]
    far = ((c - c[entries[0]]) ** 2).sum(1)
    while len(entries) < count:
        entries.append(int(np.argmax(far)))
        far = np.minimum(far, ((c - c[entries[-1]]) ** 2).sum(1))
    return Graph(c, edges, np.array(entries, np.int32))


def graph_search(g: Graph, x: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for each row of x: (ids, distances) of BEAM centroids, nearest first.

    Candidates are expanded while they lie within (1 + ratio) of the nearest distance or
    are among the first WIDE.
    """
    n, k = len(x), len(g.centre)
    width = min(k, BEAM)
    norm = (g.centre * g.centre).sum(1)
    own = (x * x).sum(1)[:, None]

    def dist(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        dots = np.einsum("bmd,bd->bm", g.centre[ids], x[rows])
        return np.sqrt(np.maximum(own[rows] + norm[ids] - 2 * dots, 0))

    d = np.sqrt(np.maximum(own + norm[g.entries] - 2 * (x @ g.centre[g.entries].T), 0))
    order = np.argsort(d, axis=1)[:, :width]
    ids, d = g.entries[order], np.take_along_axis(d, order, 1)
    done = np.zeros(ids.shape, bool)
    for _ in range(4 * BEAM):
        open_ = ~done & ((d <= d[:, :1] * (1 + ratio)) | (np.arange(width) < WIDE))
        act = np.flatnonzero(open_.any(axis=1))
        if not len(act):
            break
        first = np.argmax(open_[act], axis=1)
        done[act, first] = True
        new = np.sort(g.edges[ids[act, first]], axis=1)
        nd = dist(new, act)
        seen = (new[:, :, None] == ids[act][:, None, :]).any(axis=2)
        seen[:, 1:] |= new[:, 1:] == new[:, :-1]
        nd[seen] = np.inf
        all_ids = np.concatenate([ids[act], new], axis=1)
        all_d = np.concatenate([d[act], nd], axis=1)
        all_done = np.concatenate([done[act], np.zeros(new.shape, bool)], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        ids[act], d[act], done[act] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_d, all_done))
    return ids, d


def placer(g: Graph, dim: int, ratio: float, most: int, probe_ratio: float, probes: int):
    """mapInArrow: (id, vec) to (id, vec as a unit vector, near, held): lists, nearest first, of which the first ``held`` hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                x = unit(matrix(part.column("vec"), dim)).astype(np.float32)
                ids, d = graph_search(g, x, max(ratio, probe_ratio))
                at = np.arange(ids.shape[1])
                held = ((d <= d[:, :1] * (1 + ratio)) & (at < most)).sum(1).clip(1)
                inside = ((d <= d[:, :1] * (1 + probe_ratio)) & (at < probes)) | (at < held[:, None])
                ends = np.concatenate([[0], np.cumsum(inside.sum(1))]).astype(np.int32)
                near = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[inside].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists(x), near, pa.array(held.astype(np.int32))], names=["id", "vec", "near", "held"])

    return run


@dataclass
class Index:
    """Placed vectors (id, vec, near, held) and the number of blocks of each list."""

    placed: DataFrame
    blocks: DataFrame
    dim: int


def build_index(rows: DataFrame, reps: DataFrame, dim: int, probe_ratio: float, probes: int, ratio: float = RATIO, most: int = MOST, list_size: int = LIST_SIZE) -> Index:
    """Index (id, vec) rows ``reps``: every one is placed; centroids are fitted on a bounded sample of ``rows``.

    ``rows`` holds the vectors before equal ones are merged, so that no pass over the
    merged ones has to be stored besides the placed table.
    """
    spark = rows.sparkSession
    n = rows.count()
    k = int(min(MAX_LISTS, max(1, -(-n // list_size))))
    sample = max(SAMPLE, PER_LIST * k)
    share = min(1.0, 1.2 * sample / max(n, 1))
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else rows
    found = drawn.select("vec").limit(sample).toArrow()
    x = unit(matrix(found.column("vec").combine_chunks(), dim)).astype(np.float32) if found.num_rows else np.ones((1, dim), np.float32)
    g = centroid_graph(balanced_centroids(x, k))
    placed = cut(reps.select("id", "vec").mapInArrow(placer(g, dim, ratio, most, probe_ratio, probes), "id string, vec array<float>, near array<int>, held int"), "placed")
    sizes = placed.select(F.explode(F.slice("near", 1, F.col("held"))).alias("list")).groupBy("list").count()
    many = sizes.select("list", F.ceil(F.col("count") / BLOCK).cast("int").alias("nb")).filter("nb > 1").collect()  # at most MAX_LISTS
    blocks = spark.createDataFrame([tuple(r) for r in many], "list int, nb int")
    return Index(placed, blocks, dim)


def comparer(dim: int, least: float | None, k: int | None):
    """applyInArrow over one cell: probes against members, pairs above ``least`` or the k best."""

    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        ids = table.column("id").to_pylist()
        x = matrix(table.column("vec").combine_chunks(), dim)
        p, m = np.flatnonzero(role & PROBE), np.flatnonzero(role & MEMBER)
        left, right, cos = [], [], []
        names = np.array(ids, dtype=object)
        for s in range(0, len(p) if len(m) else 0, 1024):
            own = p[s : s + 1024]
            score = x[own] @ x[m].T
            if least is not None:
                i, j = np.nonzero(score >= least - 1e-4)
            else:
                top = np.argpartition(-score, min(k, len(m) - 1), axis=1)[:, : k + 1] if len(m) > k + 1 else np.tile(np.arange(len(m)), (len(own), 1))
                i, j = np.repeat(np.arange(len(own)), top.shape[1]), top.ravel()
            a, b = own[i], m[j]
            other = names[a] != names[b] if len(a) else np.empty(0, bool)
            a, b = a[other], b[other]
            exact = (unit(x[a]) * unit(x[b])).sum(1) if len(a) else np.empty(0)
            if least is not None:
                a, b, exact = a[exact >= least], b[exact >= least], exact[exact >= least]
            left += [ids[v] for v in a]
            right += [ids[v] for v in b]
            cos.append(exact)
        return pa.table({"a": pa.array(left, pa.string()), "b": pa.array(right, pa.string()), "cosine": pa.array(np.concatenate(cos) if cos else np.empty(0), pa.float64())})

    return run


def cells(index: Index, asked: Column | None = None) -> DataFrame:
    """Rows (list, mb, pb, role, id, vec): every probe meets every member block of its lists.

    A row is a member of the first ``held`` of its lists and, if ``asked``, a probe of all of
    them; without ``asked`` every row is a probe of the lists that hold it. A list of one
    block takes a row that is both only once.
    """
    near = F.slice("near", 1, F.col("held")) if asked is None else F.when(asked, F.col("near")).otherwise(F.slice("near", 1, F.col("held")))
    rows = index.placed.select("id", "vec", "held", (asked if asked is not None else F.lit(True)).alias("ask"), F.posexplode(near).alias("at", "list"))
    rows = rows.join(F.broadcast(index.blocks), "list", "left").withColumn("nb", F.coalesce("nb", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int")).withColumn("member", F.col("at") < F.col("held"))
    every = F.sequence(F.lit(0), F.col("nb") - 1)
    cell = lambda mb, pb, role: F.struct(mb.alias("mb"), pb.alias("pb"), role.alias("role"))
    none = F.array().cast("array<struct<mb:int,pb:int,role:int>>")
    zero = F.lit(0)
    single = F.array(cell(zero, zero, F.when(F.col("member"), MEMBER).otherwise(0) + F.when(F.col("ask"), PROBE).otherwise(0)))
    members = F.when(F.col("member"), F.transform(every, lambda b: cell(F.col("own"), b, F.lit(MEMBER)))).otherwise(none)
    probes = F.when(F.col("ask"), F.transform(every, lambda b: cell(b, F.col("own"), F.lit(PROBE)))).otherwise(none)
    placed = rows.select("list", "id", "vec", F.explode(F.when(F.col("nb") == 1, single).otherwise(F.concat(members, probes))).alias("c"))
    return placed.select("list", "c.mb", "c.pb", "c.role", "id", "vec").filter("role > 0")


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, vec) with one row for each distinct vector, and (member, id) of the ids in company.

    A class is named by its smallest id and its vector's key, as an id may have several
    vectors. Equal vectors are merged before and in one shuffle on the vector; members
    are found by key, without moving vectors.
    """
    reps = rows.groupBy("vec").agg(F.min("id").alias("first")).select(F.concat_ws("\u0000", "first", vector_key("vec")).alias("id"), "vec")
    keyed = rows.select("id", vector_key("vec").alias("key"))
    named = keyed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first <> last")
    same = keyed.distinct().join(named, "key").select(F.col("id").alias("member"), F.concat_ws("\u0000", "first", "key").alias("id"))
    return reps, cut(same, "members")


def _plain(col: str) -> Column:
    return F.substring_index(F.col(col), "\u0000", 1)


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, least: float, dim: int = 64) -> DataFrame:
    """(id_a, id_b, cosine): different ids whose usable vectors have at least that cosine, the smaller first.

    Each vector is held by the lists within RATIO of its nearest centroid's distance, at most MOST, and meets
    the others there; two vectors meet if they share a list, which near ones almost always do (the README gives
    the measured recall). Every pair is compared exactly. Null, empty, short, zero and NaN-holding vectors and
    null ids are left out; repeated rows count once; an id with several vectors is paired by any of them, with
    the highest cosine.
    """
    rows = usable(df, id_col, vec_col, dim)
    reps, same = classes(rows)
    index = build_index(rows, reps, dim, probe_ratio=0.0, probes=1)
    raw = cells(index).groupBy("list", "mb", "pb").applyInArrow(comparer(dim, least, None), "a string, b string, cosine double")
    pairs = raw.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    x, y = same.select(F.col("id").alias("a"), F.col("member").alias("x")), same.select(F.col("id").alias("b"), F.col("member").alias("y"))
    between = pairs.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", _plain("a")).alias("x"), F.coalesce("y", _plain("b")).alias("y"), "cosine")
    within = x.join(y, F.col("a") == F.col("b")).select("x", "y", F.lit(1.0).alias("cosine"))
    both = between.unionByName(within).filter("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "cosine")
    return both.groupBy("id_a", "id_b").agg(F.max("cosine").alias("cosine"))


def is_asked(key: str | Column, every: int) -> Column:
    """Whether an id is a query: the number that its text hashes to is divisible by ``every``."""
    return F.pmod(hashed(key), F.lit(every)) == 0


def nearest_vectors(df: DataFrame, id_col: str, vec_col: str, k: int = 10, dim: int = 64, every: int = 20) -> DataFrame:
    """(id, neighbour, cosine, place): the k most similar vectors of every ``every``-th id.

    Queries are the ids whose hash is divisible by ``every`` (1: all), against all rows.
    Border vectors are replicated (see similar_pairs); a query searches the lists within
    PROBE_RATIO of the nearest centroid's distance, at most PROBES. Ids of equal vectors come
    first, at cosine 1; of each class of equal vectors the k + 1 smallest ids can be named.
    Ties go by id. An id with several vectors is asked with each of them and found by any,
    with the highest cosine.
    """
    rows = usable(df, id_col, vec_col, dim)
    reps, same = classes(rows)
    index = build_index(rows, reps, dim, probe_ratio=PROBE_RATIO, probes=PROBES)
    wanted = same.filter(is_asked("member", every))
    index.placed = index.placed.join(wanted.select("id", F.lit(True).alias("w")).distinct(), "id", "left").withColumn("ask", F.coalesce("w", is_asked(_plain("id"), every))).drop("w")
    raw = cells(index, asked=F.col("ask")).groupBy("list", "mb", "pb").applyInArrow(comparer(dim, None, k), "a string, b string, cosine double").distinct()
    best = lambda key: Window.partitionBy(key).orderBy(F.col("cosine").desc(), F.col("b").asc())
    top = raw.withColumn("p", F.row_number().over(best("a"))).filter(F.col("p") <= k).select("a", "b", "cosine")
    first = same.withColumn("p", F.row_number().over(Window.partitionBy("id").orderBy("member"))).filter(F.col("p") <= k + 1).select("id", "member")
    around = top.join(first, F.col("b") == F.col("id"), "left").select("a", F.coalesce("member", _plain("b")).alias("b"), "cosine")
    own = first.select(F.col("id").alias("a"), F.col("member").alias("b"), F.lit(1.0).alias("cosine"))
    alone = index.placed.filter(is_asked(_plain("id"), every)).select(_plain("id").alias("q"), F.col("id").alias("a"))
    ids = wanted.select(F.col("member").alias("q"), F.col("id").alias("a")).unionByName(alone).distinct()
    named = ids.join(around.unionByName(own), "a").filter("q <> b").groupBy(F.col("q").alias("id"), "b").agg(F.max("cosine").alias("cosine"))
    return named.withColumn("place", F.row_number().over(best("id"))).filter(F.col("place") <= k).select("id", F.col("b").alias("neighbour"), "cosine", "place")


def measured_recall(df: DataFrame, id_col: str, vec_col: str, k: int = 10, dim: int = 64, every: int = 20) -> DataFrame:
    """(recall): the share of the true k best cosines of every query that nearest_vectors reaches.

    The queries are compared with all rows in blocks. Equal cosines may be swapped, so places are
    compared by cosine and not by id.
    """
    rows = usable(df, id_col, vec_col, dim).select("id", F.col("vec").alias("vec")).groupBy("id").agg(F.min("vec").alias("vec"))
    true = top_vectors(rows, k, "cosine", sources=rows.filter(is_asked("id", every)), digits=6)
    least = true.groupBy(F.col("source").alias("id")).agg(F.min("prediction").alias("least"), F.count("*").alias("n"))
    found = nearest_vectors(df, id_col, vec_col, k, dim, every)
    hits = found.join(least, "id").filter(F.col("cosine") >= F.col("least") - 2e-6).groupBy("id").agg(F.count("*").alias("hit"))
    return least.join(hits, "id", "left").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.sum("n")).alias("recall"))
