"""Co-occurrence similarity of items (over users) or users (over items)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.packed import decode, encode, net
from quern.functions.rounding import half_up
from quern.operators.positions import with_positions
from quern.operators.quantiles import quantiles
from quern.scratch import cut, release

FLUSH = 4_000_000
CHUNK = 2_048  # longer lists are cut into chunks, and pairs of chunks are spread over tasks
BROADCAST_BYTES = 64 << 20
LEAST = 1e-300
READERS = 12


def _weight(trans: str, value: Column) -> Column:
    f = {"ones": F.lit(1.0), "log": F.log10(value + 1), "none": value.cast("double")}.get(trans)
    if f is None:
        raise ValueError("trans must be 'ones', 'log' or 'none'")
    return f


def weighted_rows(obs: DataFrame, on: str, of: str, trans: str = "ones", value: str = "rating") -> DataFrame:
    """(k, i, v): one row per pair of non-null ids, ratings of a repeated pair added up, then transformed.

    With 'ones' every pair weighs 1; otherwise pairs whose weight is null or NaN are left out.
    """
    rows = obs.select(F.col(on).alias("k"), F.col(of).cast("string").alias("i"), *([] if trans == "ones" else [F.col(value).cast("double").alias("r")])).filter("k is not null and i is not null")
    if trans == "ones":
        return rows.distinct().withColumn("v", F.lit(1.0))
    v = _weight(trans, F.col("r"))
    return rows.groupBy("k", "i").agg(F.sum("r").alias("r")).select("k", "i", v.alias("v")).filter("v is not null and not isnan(v)")


def cooccurrence(obs: DataFrame, on: str = "userid", of: str = "itemid", trans: str = "ones", min_count: float = 0, value: str = "rating") -> DataFrame:
    """(a, b, value) for a <> b: the sum over ``on`` of f(rating a) f(rating b), as a relational plan.

    f is 1 ('ones'), log10(rating + 1) ('log') or the rating ('none'); each unordered pair
    is joined and summed once and mirrored afterwards. ``coded_pairs`` gives the same
    pairs packed, with long lists spread over tasks.
    """
    rows = weighted_rows(obs, on, of, trans, value)
    side = lambda s: rows.select("k", F.col("i").alias(s), F.col("v").alias(f"v_{s}"))
    half = side("a").join(side("b"), "k").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum(F.col("v_a") * F.col("v_b")).alias("value"))
    if min_count:
        half = half.filter(F.col("value") >= min_count)
    both = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return half.select(F.explode(both).alias("p"), "value").select("p.a", "p.b", "value")


def normalise_rows(sim: DataFrame) -> DataFrame:
    """value / sum of |value| over the row of a; sums are a small table joined back."""
    sums = sim.groupBy("a").agg(F.sum(F.abs("value")).alias("t"))
    return sim.join(sums, "a").select("a", "b", (F.col("value") / F.nullif(F.col("t"), F.lit(0.0))).alias("value"))


def symmetrise(sim: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return sim.select(F.explode(both).alias("p"), "value").select("p.a", "p.b", "value").groupBy("a", "b").agg(F.sum("value").alias("value"))


def prune(sim: DataFrame, ratio: float = 0.0, least: float = 0.0) -> DataFrame:
    """Entries of at least max(least, the percentile ``ratio`` of all entries)."""
    bound = least
    if ratio > 0:
        found = quantiles(sim, "value", [int(100 * ratio) / 100])
        bound = max(least, found[0]) if found else least
    return sim.filter(F.col("value") >= bound) if bound > 0 else sim


def higher_degree(base: DataFrame, degree: int = 2, prune_ratio: float = 0.5, decay: float = 0.3, min_cooccurrence: float = 3) -> DataFrame:
    """The matrix plus its pruned higher degrees, rescaled to the first's total; (a, b, value), a <> b.

    H starts as the pruned matrix; step i of ``degree`` - 1 adds decay^i H H without diagonal.
    The factor is total / (sum of H + 1). Relational; ``top_second_degree`` is the packed plan of degree 2.
    """
    if degree < 2:
        return base
    base = cut(base, "base")
    high = prune(base, prune_ratio, min_cooccurrence)
    for i in range(degree - 1):
        high = cut(high, "degree")
        a, b = high.toDF("a", "m", "v1"), high.toDF("m", "b", "v2")
        square = a.join(b, "m").filter("a <> b").groupBy("a", "b").agg(F.sum(F.col("v1") * F.col("v2") * decay ** (i + 1)).alias("value"))
        high = high.unionByName(square).groupBy("a", "b").agg(F.sum("value").alias("value"))
    high = cut(high, "degree")
    total = base.agg(F.sum("value")).first()[0] or 0.0
    factor = total / ((high.agg(F.sum("value")).first()[0] or 0.0) + 1)
    return base.unionByName(high.withColumn("value", F.col("value") * factor)).groupBy("a", "b").agg(F.sum("value").alias("value"))


def top_similar(sim: DataFrame, n: int, digits: int = 9, source: str = "itemid_source", target: str = "itemid") -> DataFrame:
    """(source, target, prediction): the n best per source, scores rounded first, ties by id as text."""
    rows = sim.select(F.col("a").cast("string").alias(source), F.col("b").cast("string").alias(target), F.round("value", digits).alias("prediction"))
    w = Window.partitionBy(source).orderBy(F.col("prediction").desc(), F.col(target).asc())
    return rows.withColumn("__q_r", F.row_number().over(w)).filter(F.col("__q_r") <= n).drop("__q_r")


def _pieces(lists: DataFrame, parts: int) -> DataFrame:
    """(l, lv, r, rv): short lists whole, of longer ones every pair of chunks, spread over tasks.

    A list of a third of all rows so becomes many equal pieces of at most CHUNK x CHUNK pairs.
    """
    none = F.lit(None)
    short = lists.filter(F.size("codes") <= CHUNK).select(F.col("codes").alias("l"), F.col("vals").alias("lv"), none.cast("array<int>").alias("r"), none.cast("array<double>").alias("rv"))
    steps = F.sequence(F.lit(0), F.floor((F.size("codes") - 1) / CHUNK).cast("int"))
    piece = lambda c: F.transform(steps, lambda i: F.slice(c, i * CHUNK + 1, CHUNK))
    chunks = lists.filter(F.size("codes") > CHUNK).select("k", F.posexplode(F.arrays_zip(piece("codes").alias("c"), piece("vals").alias("v"))).alias("n", "x"))
    chunks = chunks.select("k", "n", F.col("x.c").alias("c"), F.when(F.size("x.v") > 0, F.col("x.v")).alias("v"))
    a = chunks.select("k", F.col("n").alias("i"), F.col("c").alias("l"), F.col("v").alias("lv"))
    b = chunks.select("k", F.col("n").alias("j"), F.col("c").alias("r0"), F.col("v").alias("rv0"))
    apart = F.col("i") < F.col("j")
    long = a.join(b, "k").filter("i <= j").repartition(parts, "k", "i", "j")
    return short.unionByName(long.select("l", "lv", F.when(apart, F.col("r0")).alias("r"), F.when(apart, F.col("rv0")).alias("rv")))


def _emit(buckets: int, weighted: bool):
    """mapInArrow: pieces to netted (a, b) sums of every ordered pair, one block a bucket."""

    def blocks(held: list[tuple[np.ndarray, np.ndarray | None]]) -> pa.RecordBatch:
        keys, sums = net(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]) if weighted else None)
        keys, sums = np.concatenate([keys, ((keys & 0xFFFFFFFF) << 32) | (keys >> 32)]), np.concatenate([sums, sums])
        own = (keys >> 32) % buckets
        order = np.lexsort((keys, own))
        own, keys, sums = own[order], keys[order], sums[order]
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
        coded = [pack(keys[i:j], sums[i:j], weighted) for i, j in zip(at, np.append(at[1:], len(own)))]
        return pa.RecordBatch.from_arrays([pa.array(own[at], pa.int32()), pa.array([c[0] for c in coded], pa.binary()), pa.array([c[1] for c in coded], pa.binary())], names=["bucket", "keys", "counts"])

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        left, right = batch.column("l"), batch.column("r")
        values = left.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        vals = batch.column("lv").flatten().to_numpy(zero_copy_only=False) if weighted else None
        size = left.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(size) - size
        paired = right.is_valid().to_numpy(zero_copy_only=False)
        for n in np.unique(size[~paired]):
            if n < 2:
                continue
            i, j = np.triu_indices(int(n), 1)
            own = start[(size == n) & ~paired]
            step = max(1, FLUSH // len(i))
            for s in range(0, len(own), step):
                at = own[s : s + step, None] + np.arange(n)
                mat = values[at]
                yield ((mat[:, i] << 32) | mat[:, j]).ravel(), (vals[at][:, i] * vals[at][:, j]).ravel() if weighted else None
        for k in np.flatnonzero(paired):
            a, b = values[start[k] : start[k] + size[k]], np.asarray(right[int(k)].values.to_numpy(zero_copy_only=False), np.int64)
            v = np.outer(vals[start[k] : start[k] + size[k]], batch.column("rv")[int(k)].values.to_numpy(zero_copy_only=False)).ravel() if weighted else None
            yield ((a[:, None] << 32) | b).ravel(), v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, amount = [], 0
        for batch in batches:
            for part in pieces(batch):
                held.append(part)
                amount += len(part[0])
                if amount >= FLUSH:
                    yield blocks(held)
                    held, amount = [], 0
        if held:
            yield blocks(held)

    return run


def pack(keys: np.ndarray, sums: np.ndarray, weighted: bool) -> tuple[bytes, bytes]:
    coded, counts = encode(keys, sums if not weighted else np.ones(len(keys), np.int64))
    return coded, sums.astype(np.float64).tobytes() if weighted else counts


def unpack(table: pa.Table, weighted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum) of the blocks of one bucket, netted and sorted."""
    parts = []
    for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist()):
        parts.append((decode(k, b"")[0], np.frombuffer(c, np.float64)) if weighted else decode(k, c))
    keys, sums = net(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts]))
    return keys >> 32, keys & 0xFFFFFFFF, sums


@dataclass
class Coded:
    """Pairs of ``of`` within ``on`` as packed integers.

    ``placed`` is the vocabulary (i, t, p) with the codes p - 1 in order of the names;
    ``names`` and ``totals`` (row sums) the same by code; ``lists`` (k, codes, vals);
    ``pairs`` is the number of ordered pairs of the lists. ``found`` (bucket, keys, counts) has every ordered
    pair in the bucket of its first code; ``coded_lists`` leaves it out.
    """

    placed: DataFrame
    names: np.ndarray
    totals: np.ndarray
    lists: DataFrame
    pairs: float
    weighted: bool
    found: DataFrame | None = None
    buckets: int = 0


def _small(placed: DataFrame) -> bool:
    return (placed.agg(F.sum(F.octet_length("i") + 40)).first()[0] or 0) <= BROADCAST_BYTES


def _others(n: int):
    """mapInArrow: one row a partition, by code the sum of its lists' lengths less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(n)
        for batch in batches:
            col = batch.column("codes")
            size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            out += np.bincount(col.flatten().to_numpy(zero_copy_only=False), np.repeat(size - 1.0, size), minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["t"])

    return run


def coded_sets(obs: DataFrame, on: str, of: str, value: str | None = None) -> Coded | None:
    """Lists of unweighted codes in one shuffle of the rows: the vocabulary comes first, lengths and row sums from the lists.

    With ``value`` the lists also hold every row's code and value (raw, rating).
    """
    rows = obs.select(F.col(on).alias("k"), F.col(of).cast("string").alias("i"), *([F.col(value).cast("double").alias("v")] if value else [])).filter("k is not null and i is not null")
    placed = cut(with_positions(rows.select("i").distinct(), [], [F.col("i").asc()], out="p"), "vocabulary")
    if not _small(placed):
        return None
    names = placed.select("i", "p").orderBy("p").select("i").toArrow()["i"].to_numpy()
    codes = F.broadcast(placed.select("i", (F.col("p") - 1).cast("int").alias("code")))
    # A list holds each item once, so it is no longer than the vocabulary, which is bounded above.
    if value:
        lists = rows.join(codes, "i").groupBy("k").agg(F.collect_list(F.struct("code", "v")).alias("x"))
        lists = lists.select("k", F.array_sort(F.array_distinct("x.code")).alias("codes"), F.col("x.code").alias("raw"), F.col("x.v").alias("rating"))
    else:
        lists = rows.join(codes, "i").groupBy("k").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    lists = cut(lists.withColumn("vals", F.lit(None).cast("array<double>")), "lists")
    totals = np.zeros(len(names))
    for row in lists.select("codes").coalesce(READERS).mapInArrow(_others(len(names)), "t binary").toLocalIterator():
        totals += np.frombuffer(row.t)
    return Coded(placed, names, np.maximum(totals, LEAST), lists, float(totals.sum()), False)


def coded_lists(obs: DataFrame, on: str = "userid", of: str = "itemid", max_list: int | None = None, trans: str = "ones", value: str = "rating") -> Coded | None:
    """The vocabulary and the coded lists; None where a weight is negative or the vocabulary over ``BROADCAST_BYTES``.

    Lists longer than ``max_list`` are left out if it is given; rows with null ids always are.
    Row sums are closed forms of the lists' lengths (or sums), so no pass over pairs is needed for them.
    """
    weighted = trans != "ones"
    if not weighted and not max_list:
        return coded_sets(obs, on, of)
    rows = cut(weighted_rows(obs, on, of, trans, value), "rows")
    if weighted and not rows.filter("v < 0").isEmpty():
        return None
    sizes = rows.groupBy("k").agg(F.count("*").alias("h"), F.sum("v").alias("s"))
    if max_list:
        sizes = sizes.filter(F.col("h") <= max_list)
    sizes = cut(sizes, "sizes")
    own = F.sum(F.col("v") * (F.col("s") - F.col("v"))) if weighted else F.sum(F.col("h") - 1).cast("double")
    items = rows.join(sizes, "k").groupBy("i").agg(own.alias("t"))
    placed = cut(with_positions(items, [], [F.col("i").asc()], out="p"), "vocabulary")
    if not _small(placed):
        return None
    local = placed.select("i", "t").orderBy("p").toArrow()
    names, totals = local["i"].to_numpy(), np.maximum(local["t"].to_numpy(), LEAST)
    codes = F.broadcast(placed.select("i", (F.col("p") - 1).cast("int").alias("code")))
    kept = rows.join(sizes.select("k"), "k", "left_semi") if max_list else rows
    kept = kept.join(codes, "i")
    # A list holds each item once, so it is no longer than the vocabulary, which is bounded above.
    if weighted:
        lists = kept.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("code", "v"))).alias("x")).select("k", F.col("x.code").alias("codes"), F.col("x.v").alias("vals"))
    else:
        lists = kept.groupBy("k").agg(F.array_sort(F.collect_list("code")).alias("codes")).withColumn("vals", F.lit(None).cast("array<double>"))
    lists = cut(lists, "lists")
    pairs = float(sizes.agg(F.sum(F.col("h") * (F.col("h") - 1))).first()[0] or 0)
    release(rows, sizes)
    return Coded(placed, names, totals, lists, pairs, weighted)


def with_pairs(coded: Coded, per: int = FLUSH) -> Coded:
    """The same with its packed pairs, about ``per`` a bucket."""
    coded.buckets = max(8, math.ceil(coded.pairs / per))
    parts = max(int(coded.lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(4_096, math.ceil(coded.pairs / 2 / (16 * FLUSH))))
    coded.found = _pieces(coded.lists, parts).mapInArrow(_emit(coded.buckets, coded.weighted), "bucket int, keys binary, counts binary")
    return coded


def coded_pairs(obs: DataFrame, on: str = "userid", of: str = "itemid", max_list: int | None = None, per: int = FLUSH, trans: str = "ones", value: str = "rating") -> Coded | None:
    coded = coded_lists(obs, on, of, max_list, trans, value)
    return coded and with_pairs(coded, per)


def by_bucket(found: DataFrame, buckets: int):
    return found.repartition(min(buckets, 4_096), "bucket").groupBy("bucket")


def _row_sums(weighted: bool, least: float):
    def run(table: pa.Table) -> pa.Table:
        a, _, sums = unpack(table, weighted)
        keep = sums >= least
        code, at = np.unique(a[keep], return_inverse=True)
        return pa.table({"code": pa.array(code, pa.int64()), "t": np.bincount(at, sums[keep], minlength=len(code))})

    return run


def row_sums(coded: Coded, least: float) -> np.ndarray:
    """Row sums of the entries of at least ``least``; one number a code, of a vocabulary checked before."""
    local = by_bucket(coded.found, coded.buckets).applyInArrow(_row_sums(coded.weighted, least), "code long, t double").toArrow()
    out = np.full(len(coded.names), LEAST)
    out[local["code"].to_numpy()] = local["t"].to_numpy()
    return out


def _best(totals: np.ndarray, names: np.ndarray, n: int, digits: int, weighted: bool, least: float, both: bool):
    """applyInArrow over a bucket: w = v / t_a (+ v / t_b), the n best per a."""

    def run(table: pa.Table) -> pa.Table:
        a, b, v = unpack(table, weighted)
        if least:
            a, b, v = a[v >= least], b[v >= least], v[v >= least]
        w = half_up(v / totals[a] + v / totals[b] if both else v / totals[a], digits)
        # Codes follow the order of the names, so a sort on b breaks ties by name.
        order = np.lexsort((b, -w, a))
        a, b, w = a[order], b[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
        place = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        keep = place < n
        return pa.table({"source": pa.array(names[a[keep]], pa.string()), "target": pa.array(names[b[keep]], pa.string()), "prediction": pa.array(w[keep], pa.float64())})

    return run


def top_cooccurring(obs: DataFrame, n: int, on: str = "userid", of: str = "itemid", digits: int = 9, max_list: int | None = None, trans: str = "ones", min_count: float = 0, both: bool = True, value: str = "rating", source: str = "itemid_source", target: str = "itemid") -> DataFrame:
    """(source, target, prediction): the n most similar by row-normalised sums, symmetrised with ``both``.

    A row's total is a closed form of its lists' lengths or sums, so the score v_ab / t_a + v_ab / t_b needs no
    second pass over the pairs (with ``min_count`` it needs one). Pairs are netted and ranked on packed integers in
    numpy, a few bytes each on the wire, which is several times faster than exploding them as rows. The vocabulary
    and totals go to the tasks only while they stay under 64 MB; a larger one, and negative weights, take the
    relational plan with the same result. Where every connected part of items is small next to the whole, lists travel
    instead of pairs and a part's pairs never leave its task (``top_by_part``). Lists longer than ``max_list`` are left out if it is given; null ids
    and repeated pairs add nothing.
    """
    coded = coded_lists(obs, on, of, max_list, trans, value)
    if coded is None:
        known = obs
        if max_list:
            short = weighted_rows(obs, on, of, trans, value).groupBy("k").count().filter(F.col("count") <= max_list)
            known = obs.join(short.select(F.col("k").alias(on)), on, "left_semi")
        sim = normalise_rows(cooccurrence(known, on, of, trans, min_count, value))
        return top_similar(symmetrise(sim) if both else sim, n, digits, source, target)
    if not coded.weighted:
        from quern.operators.scoring import top_by_part

        best = top_by_part(coded, n, digits, min_count if min_count > 1 else 0, both)
        if best is not None:
            return best.toDF(source, target, "prediction")
    coded = with_pairs(coded)
    if min_count > 0 and (coded.weighted or min_count > 1):
        coded.found = cut(coded.found, "pairs")
        totals = row_sums(coded, min_count)
    else:
        totals, min_count = coded.totals, 0
    best = by_bucket(coded.found, coded.buckets).applyInArrow(_best(totals, coded.names, n, digits, coded.weighted, min_count, both), "source string, target string, prediction double")
    return best.toDF(source, target, "prediction")
