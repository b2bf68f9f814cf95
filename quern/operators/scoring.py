"""Recommendations over whole co-occurrence similarities: histories times matrix in blocks, cut only after the sum."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.packed import decode
from quern.functions.rounding import half_up
from quern.operators import components as cc
from quern.operators import cooccurrence as co
from quern.operators.cooccurrence import pack, unpack
from quern.operators import observations as ob
from quern.operators import recommend as re_
from quern.operators.positions import with_positions
from quern.scratch import cut

CELLS, EDGES, PAIRS, ENTRIES = 1 << 19, 1 << 19, 2_000_000, 20_000_000
LEAST = 1e-300  # a similarity that rounds to zero still makes a candidate
HELD = 8_000_000  # list entries of connected parts that one task holds
MADE, USED = 500_000, 4_000_000  # pairs of which it makes and scores at a time


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    col = table.column(name).combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _product(size: np.ndarray, link: np.ndarray, weight: np.ndarray | None, ptr: np.ndarray, cols: np.ndarray, vals: np.ndarray, width: int, n: int | None, digits: int, known, finish=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, score) of the n best of each row of a sparse product, ties by column.

    Row r of the left matrix has the next size[r] entries of ``link`` (and ``weight``), row j of the right one
    cols[ptr[j]:ptr[j + 1]] and vals. known(first, last) gives the cells to leave out of a range of rows;
    finish(first, last, cells) may add to the sums and scale them before they are ranked.
    """
    start = np.concatenate([[0], np.cumsum(size)])
    step = max(1, CELLS // max(1, width))
    for first in range(0, len(size), step):
        last = min(first + step, len(size))
        j = link[start[first] : start[last]]
        base = np.repeat(np.arange(last - first) * width, size[first:last])
        deg = ptr[j + 1] - ptr[j]
        ends, at = np.cumsum(deg), 0
        acc = np.zeros((last - first) * width)
        while at < len(j):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EDGES, side="right")))
            d = deg[at:to]
            where = np.arange(int(d.sum())) + np.repeat(ptr[j[at:to]] - (np.cumsum(d) - d), d)
            w = vals[where]
            if weight is not None:
                w = w * np.repeat(weight[start[first] + at : start[first] + to], d)
            acc += np.bincount(cols[where] + np.repeat(base[at:to], d), w, minlength=len(acc))
            at = to
        if finish is not None:
            acc = finish(first, last, acc)
        acc[known(first, last)] = 0
        acc = acc.reshape(last - first, width)
        score = np.where(acc > 0, half_up(acc, digits), -1.0)
        hit = acc > 0
        if n is not None and n < width:
            hit &= score >= np.partition(score, width - n, axis=1)[:, [width - n]]
        r, c = np.nonzero(hit)
        v = score[r, c]
        order = np.lexsort((c, -v, r))
        r, c, v = r[order], c[order], v[order]
        if n is not None:
            keep = np.arange(len(r)) - np.searchsorted(r, r) < n
            r, c, v = r[keep], c[keep], v[keep]
        yield r + first, c, v


def _table(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], users: np.ndarray, items: np.ndarray) -> pa.Table:
    r, c, v = (np.concatenate([x[k] for x in rows]) if rows else np.empty(0, kind) for k, kind in enumerate((np.int64, np.int64, np.float64)))
    return pa.table({"userid": pa.array(users[r], pa.string()), "itemid": pa.array(items[c], pa.string()), "prediction": pa.array(v, pa.float64())})


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places first[k], .., first[k] + size[k] - 1, one k after another."""
    return np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)


def _waves(cost: np.ndarray, each: int) -> Iterator[slice]:
    """Stretches of about ``each`` in sum."""
    wave = np.floor((np.cumsum(cost) - cost) / each).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], wave[1:] != wave[:-1]])) if len(wave) else np.empty(0, np.int64)
    return (slice(i, j) for i, j in zip(at, np.append(at[1:], len(wave))))


def _first(r: np.ndarray, c: np.ndarray, v: np.ndarray, n: int | None, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score, rank) of the n best of each row, ties by column; all for None."""
    v = half_up(v, digits)
    order = np.lexsort((c, -v, r))
    r, c, v = r[order], c[order], v[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    keep = rank < (len(rank) if n is None else n)
    return r[keep], c[keep], v[keep], rank[keep]


def _joined(parts: list[tuple], kinds: tuple) -> list[np.ndarray]:
    return [np.concatenate([x[k] for x in parts]) if parts else np.empty(0, kind) for k, kind in enumerate(kinds)]


def _similar(lists_of: np.ndarray, first: np.ndarray, c: np.ndarray, held: np.ndarray, start: np.ndarray, cost: np.ndarray, weigh, least: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ptr, column, similarity): for every code j the codes c[column] that share a list with it, ``MADE`` pairs at a time.

    Code k is in the lists lists_of[first[k]:first[k + 1]], list l holds held[start[l]:start[l + 1]]; weigh(j, k, count) gives the value.
    """
    made, n = [], len(first) - 1
    ptr = np.zeros(n + 1, np.int64)
    for few in _waves(cost[c], MADE):
        own = c[few]
        many = first[own + 1] - first[own]
        outer = lists_of[_ranges(first[own], many)]
        row, long = np.repeat(np.arange(len(own), dtype=np.int32), many), start[outer + 1] - start[outer]
        key = held[_ranges(start[outer], long)].astype(np.int64)
        key <<= 32
        key |= np.repeat(row, long)
        key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        count, key = np.diff(np.append(at, len(key))), key[at]
        j, col = key >> 32, key & 0xFFFFFFFF
        keep = (j != own[col]) & (count >= least)
        j, col, count = j[keep], col[keep], count[keep]
        made.append((j.astype(np.int32), (col + few.start).astype(np.int32), np.maximum(weigh(j, own[col], count), LEAST)))
        ptr[1:] += np.bincount(j, minlength=n)
    ptr = np.cumsum(ptr)
    cols, vals, upto = np.empty(ptr[-1], np.int32), np.empty(ptr[-1]), ptr[:-1].copy()
    for k, (j, col, w) in enumerate(made):  # each in order of j, and the pieces in order of the columns
        many = np.bincount(j, minlength=n)
        to = np.arange(len(j)) + np.repeat(upto - (np.cumsum(many) - many), many)
        cols[to], vals[to], made[k] = col, w, None
        upto += many
    return ptr, cols, vals


class _Sums:
    """Rows of a sparse product with the matrix (ptr, cols, vals) of so many columns."""

    def __init__(self, ptr: np.ndarray, cols: np.ndarray, vals: np.ndarray, width: int) -> None:
        ends = ptr.tolist()
        self.cols, self.vals = ([x[i:j] for i, j in zip(ends, ends[1:])] for x in (cols, vals))
        self.deg, self.width = np.diff(ptr), width

    def row(self, link: np.ndarray, weight: np.ndarray | None) -> np.ndarray:
        at = link.tolist()
        if not at:
            return np.zeros(self.width)
        what = np.concatenate([self.vals[j] for j in at])
        if weight is not None:
            what *= np.repeat(weight, self.deg[link])
        return np.bincount(np.concatenate([self.cols[j] for j in at]), what, minlength=self.width)


def _localised(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes that occur, in order, and every entry as a place among them."""
    ids = np.flatnonzero(np.bincount(codes, minlength=n))
    place = np.full(n, -1, np.int32)
    place[ids] = np.arange(len(ids))
    return ids, place[codes]


def _item_part(totals: np.ndarray, names: pa.Array, block: np.ndarray, allowed: np.ndarray | None, n: int | None, digits: int, top: int | None):
    """The histories of connected parts: the n best of a block of their items per asked user, with ranks.

    With ``top`` only ranks below it and the pairs of the lists ``hold`` are handed on.
    """

    gap = 10.0**-digits

    def run(table: pa.Table) -> pa.Table:
        codes, size = _flat(table, "codes")
        ids, hist = _localised(codes, len(names))
        own_names = names.take(pa.array(ids)).to_numpy(zero_copy_only=False)
        start = np.concatenate([[0], np.cumsum(size)])
        order = np.argsort(hist, kind="stable")
        who, first = np.repeat(np.arange(len(size)), size)[order], np.searchsorted(hist[order], np.arange(len(ids) + 1))
        t = totals[ids]
        chosen = np.flatnonzero((block[ids] == table.column("block")[0].as_py()) & (True if allowed is None else allowed[ids]))
        asked = np.flatnonzero(table.column("asked").to_numpy())
        weigh = lambda j, k, count: half_up(count / t[j] + count / t[k], digits)
        parts, pool = [], {}
        for wave in _waves(t[chosen], USED) if len(asked) else ():
            c = chosen[wave]
            sums = _Sums(*_similar(who, first, c, hist, start, t, weigh), len(c))
            place = np.full(len(ids), -1, np.int64)
            place[c] = np.arange(len(c))
            found = []
            for x in asked.tolist():
                own = hist[start[x] : start[x + 1]]
                acc = sums.row(own, None)
                seen = place[own]
                acc[seen[seen >= 0]] = 0
                if n is None:
                    hit = np.flatnonzero(acc > 0)
                else:  # sums closer than one unit may round to the same score
                    best = pool.get(x)
                    if best is None and n < len(acc):
                        hit = np.flatnonzero(acc >= np.partition(acc, len(acc) - n)[len(acc) - n] - gap)
                    else:
                        hit = np.flatnonzero(acc >= (best[0] - gap if best is not None and len(best) == n else 0))
                    value = acc[hit]
                    if len(hit) and not value.all():
                        hit = hit[value > 0]
                if len(hit):
                    value = acc[hit]
                    found.append((x, hit, value))
                    if n is not None:
                        pool[x] = np.sort(value if best is None else np.concatenate([best, value]))[-n:]
            who_, hit, value = ([f[k] for f in found] for k in range(3))
            if found:
                parts.append((np.repeat(np.array(who_, np.int32), [len(h) for h in hit]), c[np.concatenate(hit)], np.concatenate(value)))
            del sums, found, who_, hit, value
        r, c, v, rank = _first(*_joined(parts, (np.int32, np.int64, float)), n, digits)
        if top is not None:
            held, many = _flat(table, "hold")
            place = np.full(len(names), -1, np.int64)
            place[ids] = np.arange(len(ids))
            pairs = np.repeat(np.arange(len(size)), many) * len(ids) + place[held]
            keep = (rank < top) | np.isin(r * len(ids) + c, pairs[place[held] >= 0])
            r, c, v, rank = r[keep], c[keep], v[keep], rank[keep]
        return _table([(r, c, v)], table.column("k").to_numpy(), own_names).append_column("rank", pa.array(rank, pa.int64()))

    return run


def _item_block(totals: np.ndarray, names: np.ndarray, allowed: np.ndarray | None, n: int | None, digits: int):
    """Cogroup of a block of candidates' pairs and histories: the block's n best per user."""

    def run(sims: pa.Table, lists: pa.Table) -> pa.Table:
        if not sims.num_rows or not lists.num_rows:
            return _table([], names, names)
        a, b, counts = unpack(sims)
        if allowed is not None:
            keep = allowed[a]
            a, b, counts = a[keep], b[keep], counts[keep]
        w = np.maximum(half_up(counts / totals[a] + counts / totals[b], digits), LEAST)
        order = np.argsort(b, kind="stable")
        block, cols = np.unique(a[order], return_inverse=True)
        ptr, w = np.searchsorted(b[order], np.arange(len(names) + 1)), w[order]
        del a, b, counts, order
        link, size = _flat(lists, "codes")
        start = np.concatenate([[0], np.cumsum(size)])
        local = np.full(len(names), -1, np.int64)
        local[block] = np.arange(len(block))

        def known(first: int, last: int) -> np.ndarray:
            own = local[link[start[first] : start[last]]]
            return (own + np.repeat(np.arange(last - first) * len(block), size[first:last]))[own >= 0]

        if not len(block):
            return _table([], names, names)
        rows = list(_product(size, link, None, ptr, cols, w, len(block), n, digits, known))
        return _table(rows, lists.column("k").to_numpy(), names[block])

    return run


def _top_part(totals: np.ndarray, names: pa.Array, n: int, digits: int, least: float, both: bool):
    """The lists of connected parts: the n most similar per code, of pairs that share ``least`` lists."""

    def run(table: pa.Table) -> pa.Table:
        codes, size = _flat(table, "codes")
        ids, held = _localised(codes, len(names))
        start = np.concatenate([[0], np.cumsum(size)])
        order = np.argsort(held, kind="stable")
        who, first = np.repeat(np.arange(len(size)), size)[order], np.searchsorted(held[order], np.arange(len(ids) + 1))
        t, every, out = totals[ids], np.arange(len(ids)), []
        if least:
            t = np.zeros(len(ids))
            for wave in _waves(totals[ids], USED):
                ptr, _, count = _similar(who, first, every[wave], held, start, totals[ids], lambda j, k, count: count, least)
                t += np.bincount(np.repeat(every, np.diff(ptr)), count, minlength=len(ids))
            t = np.maximum(t, LEAST)
        weigh = lambda b, a, count: half_up(count / t[a] + count / t[b] if both else count / t[a], digits)
        for wave in _waves(totals[ids], USED):
            ptr, col, w = _similar(who, first, every[wave], held, start, totals[ids], weigh, least)
            w[w == LEAST] = 0
            b = np.repeat(every, np.diff(ptr))
            # From the last key on, as lexsort does: b is in order already.
            order = np.argsort(-w, kind="stable")
            order = order[np.argsort(col[order], kind="stable")]
            b, col, w = b[order], col[order], w[order]
            keep = np.arange(len(col)) - np.searchsorted(col, col) < n
            out.append((every[wave][col[keep]], b[keep], w[keep]))
        own = names.take(pa.array(ids)).to_numpy(zero_copy_only=False)
        return _table(out, own, own)

    return run


def top_by_part(coded: co.Coded, n: int, digits: int, least: float, both: bool) -> DataFrame | None:
    """The n most similar per code made part by part; None where a part is too large for a task or for an even spread."""
    parts = cc.grouped(coded.lists.select("codes"), coded.totals, PAIRS, HELD)
    if parts.largest > HELD or (parts.blocks > 1).any():
        return None
    return cc.sent(coded.lists.select("codes"), parts).applyInArrow(_top_part(coded.totals, pa.array(coded.names, pa.string()), n, digits, least, both), "userid string, itemid string, prediction double")


def recommend_by_items(train: DataFrame, n: int | None, users: DataFrame | None = None, items: DataFrame | None = None, digits: int = 9, hold: DataFrame | None = None, top: int = 0) -> DataFrame:
    """(userid, itemid, prediction): the n best new items per user (all if None) by the whole item similarity.

    score(u, i) is the sum of sim(j, i) over all items j of u's history; sim is that of ``top_cooccurring``, with no
    cut. A task gets all histories of connected parts (of users and items that no other history links) and makes
    the similarities of a block of their items itself, so only histories travel, and scores are complete in one
    task. Parts of over ``HELD`` entries are too large for a task: there packed pairs travel (``_by_pairs``). A
    vocabulary over 64 MB takes the relational plan. With ``hold`` (userid, itemid) there is also a ``rank`` from 0,
    and rows of rank ``top`` and beyond may be left out where they are not held.
    """
    ranked = lambda df: df if hold is None else ob.zero_ranks(df, "userid", "prediction", "itemid")
    coded = co.coded_lists(train)
    if coded is None:
        sim = co.symmetrise(co.normalise_rows(co.cooccurrence(train))).select(F.col("a").alias("itemid_source"), F.col("b").alias("itemid"), F.round("value", digits).alias("prediction"))
        own = train if users is None else train.join(users.select("userid").distinct(), "userid", "left_semi")
        return ranked(re_.recommend(re_.item_scores(own, sim), n if n is not None else 1 << 31, exclude=train, items=items))
    placed, names, totals = coded.placed, coded.names, coded.totals
    allowed = None
    if items is not None:
        allowed = np.zeros(len(names), bool)
        keep = placed.join(items.select(F.col("itemid").alias("i")).distinct(), "i", "left_semi").select("p").toArrow()["p"].to_numpy()
        allowed[keep.astype(np.int64) - 1] = True
    lists = coded.lists.select(F.col("k").cast("string").alias("k"), "codes")
    parts = cc.grouped(lists, totals, PAIRS, HELD)
    if parts.largest > HELD:
        best = _by_pairs(co.with_pairs(coded, PAIRS), allowed, n, users, digits)
        return ranked(best if n is None else re_.top_per_user(best, n, digits))
    asked = F.lit(True) if users is None else F.coalesce("asked", F.lit(False))
    if users is not None:
        lists = lists.join(users.select(F.col("userid").alias("k")).distinct().withColumn("asked", F.lit(True)), "k", "left")
    none = F.array().cast("array<int>")
    whole = bool((parts.blocks == 1).all())
    if hold is not None and whole:
        codes = F.broadcast(placed.select(F.col("i").alias("itemid"), (F.col("p") - 1).cast("int").alias("code")))
        held = hold.join(codes, "itemid").groupBy(F.col("userid").alias("k")).agg(F.collect_set("code").alias("hold"))
        lists = lists.join(held, "k", "left").withColumn("hold", F.coalesce("hold", none))
    else:
        lists = lists.withColumn("hold", none)
    lists = lists.select("k", "codes", asked.alias("asked"), "hold")
    best = cc.sent(lists, parts).applyInArrow(_item_part(totals, pa.array(names, pa.string()), parts.block, allowed, n, digits, top if hold is not None and whole else None), "userid string, itemid string, prediction double, rank long")
    if whole:
        return best if hold is not None else best.drop("rank")
    best = best.drop("rank")
    return ranked(best if n is None else re_.top_per_user(best, n, digits))


def _by_pairs(coded: co.Coded, allowed: np.ndarray | None, n: int | None, users: DataFrame | None, digits: int) -> DataFrame:
    """The n best of each block of candidates of about ``PAIRS`` pairs per user.

    Every block meets every history, so each score is complete in one task. Histories are split into shards of
    about ``ENTRIES`` entries, which bounds a task's memory.
    """
    lists, found, buckets = coded.lists.withColumn("k", F.col("k").cast("string")), coded.found, coded.buckets
    if users is not None:
        lists = lists.join(users.select(F.col("userid").alias("k")).distinct(), "k", "left_semi")
    shards = max(1, math.ceil((lists.agg(F.sum(F.size("codes"))).first()[0] or 0) / ENTRIES))
    parts = min(4 * buckets * shards, 4096)
    left = found.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = lists.select("k", "codes", F.pmod(F.hash("k"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    blocks = left.repartition(parts, "bucket", "shard").groupBy("bucket", "shard").cogroup(right.repartition(parts, "bucket", "shard").groupBy("bucket", "shard"))
    return blocks.applyInArrow(_item_block(coded.totals, coded.names, allowed, n, digits), "userid string, itemid string, prediction double")


def _user_part(totals: np.ndarray, names: pa.Array, block: np.ndarray, n: int, digits: int):
    """The lists of connected parts, an item's users and their ratings: the n best per user of a block of their users."""

    gap = 10.0**-digits

    def run(table: pa.Table) -> pa.Table:
        items = table.column("k").to_numpy()
        order = np.argsort(items, kind="stable")
        place = np.empty(len(items), np.int64)
        place[order] = np.arange(len(items))
        items = items[order]
        codes, size = _flat(table, "codes")
        ids, who = _localised(codes, len(names))
        what, rating = np.repeat(place, size), _flat(table, "ratings")[0]
        order = np.lexsort((what, who))
        who, what, rating = who[order].astype(np.int64), what[order], rating[order]
        # A repeated pair counts once among the users, and each of its ratings among the scores.
        once = np.concatenate([[True], (who[1:] != who[:-1]) | (what[1:] != what[:-1])]) if len(who) else np.empty(0, bool)
        who1, what1 = who[once], what[once]
        first = np.searchsorted(who1, np.arange(len(ids) + 1))
        order = np.argsort(what1, kind="stable")
        held, start = who1[order], np.searchsorted(what1[order], np.arange(len(items) + 1))
        order = np.argsort(what, kind="stable")
        rated, rating, at = who[order], rating[order], np.searchsorted(what[order], np.arange(len(items) + 1))
        t = totals[ids]
        chosen = np.flatnonzero(block[ids] == table.column("block")[0].as_py())
        weigh = lambda v, u, count: half_up(count / t[u], digits)
        out = []
        for wave in _waves(t[chosen], USED):
            c = chosen[wave]
            # Item by item over the wave's users, since an item's users have longer rows than a user's items.
            sums = _Sums(*_similar(what1, first, c, held, start, t, weigh), len(c))
            place = np.full(len(ids), -1, np.int64)
            place[c] = np.arange(len(c))
            found, least = [], np.zeros(len(c))
            step = max(64, CELLS * 2 // len(c))
            for low in range(0, len(items), step):
                cells = np.zeros((min(step, len(items) - low), len(c)))
                for i, acc in enumerate(cells, low):
                    acc[:] = sums.row(rated[at[i] : at[i + 1]], rating[at[i] : at[i + 1]])
                    seen = place[held[start[i] : start[i + 1]]]
                    acc[seen[seen >= 0]] = 0
                cells = np.ascontiguousarray(cells.T)
                if n < cells.shape[1]:
                    least = np.maximum(least, np.partition(cells, cells.shape[1] - n, axis=1)[:, cells.shape[1] - n])
                u, i = np.nonzero((cells >= (least - gap)[:, None]) & (cells > 0))
                found.append((c[u], i + low, cells[u, i]))
            out.append(_first(*_joined(found, (np.int64, np.int64, float)), n, digits)[:3])
        return _table(out, names.take(pa.array(ids)).to_numpy(zero_copy_only=False), items)

    return run


def _user_block(totals: np.ndarray, names: np.ndarray, items: np.ndarray, n: int, digits: int):
    """Cogroup of a block of users' pairs and all histories: the n best per user of the block."""

    def run(sims: pa.Table, lists: pa.Table) -> pa.Table:
        if not sims.num_rows:
            return _table([], names, items)
        a, b, counts = unpack(sims)
        w = np.maximum(half_up(counts / totals[a], digits), LEAST)
        who = lists.column("code").to_numpy()
        cols, size = _flat(lists, "items")
        vals, _ = _flat(lists, "ratings")
        begin, length = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        begin[who], length[who] = np.cumsum(size) - size, size
        order = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        cols, vals, ptr = cols[order].astype(np.int64), vals[order], np.concatenate([[0], np.cumsum(length)])
        block, links = np.unique(a, return_counts=True)

        def known(first: int, last: int) -> np.ndarray:
            return np.concatenate([cols[ptr[u] : ptr[u + 1]] + k * len(items) for k, u in enumerate(block[first:last])])

        rows = list(_product(links, b, w, ptr, cols, vals, len(items), n, digits, known))
        return _table(rows, names[block], items)

    return run


def recommend_by_users(train: DataFrame, n: int, digits: int = 9) -> DataFrame:
    """(userid, itemid, prediction): the n best new items per user by the whole user similarity.

    score(u, i) is the sum of sim(u, v) rating(v, i) over all users v that share an item with u, sim the
    row-normalised count. Tasks hold connected parts, as in ``recommend_by_items``; larger ones send packed pairs, of
    which blocks of users meet all histories. Ratings above 0 are assumed by both, others and vocabularies over 64 MB
    take the relational plan.
    """
    coded = co.coded_sets(train, "itemid", "userid", "rating")
    positive = train.filter(F.col("rating").isNull() | ~(F.col("rating") > 0) | F.isnan("rating")).isEmpty()
    if coded is not None and positive:
        parts = cc.grouped(coded.lists.select("codes"), coded.totals, PAIRS, HELD)
        if parts.largest <= HELD:
            lists = coded.lists.select(F.col("k").cast("string").alias("k"), F.col("raw").alias("codes"), F.col("rating").alias("ratings"))
            return cc.sent(lists, parts).applyInArrow(_user_part(coded.totals, pa.array(coded.names, pa.string()), parts.block, n, digits), "userid string, itemid string, prediction double")
        coded = co.with_pairs(coded, PAIRS)
    vocabulary = cut(with_positions(train.select("itemid").distinct(), [], [F.col("itemid").asc()], out="p"), "items")
    small = (vocabulary.agg(F.sum(F.octet_length("itemid") + 40)).first()[0] or 0) <= co.BROADCAST_BYTES
    if coded is None or not small or not positive:
        sim = co.normalise_rows(co.cooccurrence(train, on="itemid", of="userid")).select(F.col("a").alias("userid"), F.col("b").alias("other"), F.round("value", digits).alias("prediction"))
        return re_.recommend(re_.user_scores(train, sim), n, exclude=train)
    placed, names, totals, found, buckets = coded.placed, coded.names, coded.totals, coded.found, coded.buckets
    items = vocabulary.orderBy("p").toArrow()["itemid"].to_numpy()
    rows = train.join(F.broadcast(placed.select(F.col("i").alias("userid"), (F.col("p") - 1).cast("int").alias("code"))), "userid")
    rows = rows.join(F.broadcast(vocabulary.select("itemid", (F.col("p") - 1).cast("int").alias("item"))), "itemid")
    lists = rows.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("item", F.col("rating").cast("double").alias("rating")))).alias("x"))
    lists = cut(lists.select("code", F.col("x.item").alias("items"), F.col("x.rating").alias("ratings")), "histories")
    right = lists.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    parts = min(4 * buckets, 4096)
    blocks = found.repartition(parts, "bucket").groupBy("bucket").cogroup(right.repartition(parts, "bucket").groupBy("bucket"))
    return blocks.applyInArrow(_user_block(totals, names, items, n, digits), "userid string, itemid string, prediction double")


def _pruned_stats(bound: float):
    """applyInArrow over a bucket of rows: (code, r, q) sums of the pruned entries and of their squares."""

    def run(table: pa.Table) -> pa.Table:
        a, _, v = unpack(table)
        keep = v >= bound
        code, at = np.unique(a[keep], return_inverse=True)
        own = v[keep].astype(np.float64)
        return pa.table({"code": pa.array(code, pa.int64()), "r": np.bincount(at, own, minlength=len(code)), "q": np.bincount(at, own * own, minlength=len(code))})

    return run


def _linked(bound: float, r: np.ndarray):
    """applyInArrow over a bucket: (code, s), for each row a the sum of H[a, m] r[m]."""

    def run(table: pa.Table) -> pa.Table:
        a, b, v = unpack(table)
        keep = v >= bound
        code, at = np.unique(a[keep], return_inverse=True)
        return pa.table({"code": pa.array(code, pa.int64()), "s": np.bincount(at, v[keep] * r[b[keep]], minlength=len(code))})

    return run


def _histogram(table: pa.Table) -> pa.Table:
    _, _, v = unpack(table)
    value, n = np.unique(v, return_counts=True)
    return pa.table({"value": pa.array(value.astype(np.float64)), "n": pa.array(n.astype(np.int64))})


def _split_cells(buckets: int):
    """mapInArrow over packed pairs: the same by (i, j), the buckets of the first and the second code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, keys, counts in zip(*[batch.column(c).to_pylist() for c in ("bucket", "keys", "counts")]):
                key, n = decode(keys, counts)
                own = (key & 0xFFFFFFFF) % buckets
                rows = [(j, *pack(key[own == j], n[own == j], False)) for j in np.unique(own).tolist()]
                yield pa.RecordBatch.from_pydict({"i": pa.array([i] * len(rows), pa.int32()), **{c: pa.array([r[k] for r in rows], t) for k, (c, t) in enumerate((("j", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())))}})

    return run


def _at_least(bound: float):
    """mapInArrow over packed pairs: those of at least ``bound``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, keys, counts in zip(*[batch.column(c).to_pylist() for c in ("bucket", "keys", "counts")]):
                key, n = decode(keys, counts)
                if (n >= bound).any():
                    k, c = pack(key[n >= bound], n[n >= bound], False)
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array([i], pa.int32()), "keys": pa.array([k], pa.binary()), "counts": pa.array([c], pa.binary())})

    return run


def _netted(table: pa.Table) -> pa.Table:
    """applyInArrow over a bucket: its packed pairs summed, in one block."""
    a, b, v = unpack(table)
    keys, counts = pack((a << 32) | b, v, False)
    return pa.table({"bucket": table.column("bucket").slice(0, 1).cast(pa.int32()), "keys": pa.array([keys], pa.binary()), "counts": pa.array([counts], pa.binary())})


def _square_block(names: np.ndarray, inverse: np.ndarray, bound: float, factor: float, decay: float, both: bool, n: int, digits: int):
    """A block of rows a and a block of columns b of the counts C: the n best b per a.

    ``kind`` 0 has the entries of C within both blocks, 1 the rows a of H, 2 the columns b of H.

    The cell is C + factor (H + decay H H) with H the entries of C of at least ``bound``, times
    1 / t_a (+ 1 / t_b); H H has no diagonal.
    """

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        part = lambda k: unpack(table.filter(pa.array(kind == k))) if (kind == k).any() else (np.empty(0, np.int64),) * 3
        (a, c, counts), (h, link, weight), (b, k, other) = part(0), part(1), part(2)
        block, ids = np.unique(np.concatenate([b, c])), np.unique(np.concatenate([a, h]))
        if not len(block) or not len(ids):
            return _table([], names, names)
        local = np.full(len(names), -1, np.int64)
        local[block] = np.arange(len(block))
        order = np.argsort(k, kind="stable")  # C is symmetric: row k of H within the block of columns
        ptr, vals, columns = np.searchsorted(k[order], np.arange(len(names) + 1)), other[order].astype(np.float64), local[b[order]]
        del b, k, other, order
        # What C and H themselves have in the cells.
        row, col = np.searchsorted(ids, a), local[c]
        own = counts * np.where(counts >= bound, 1 + factor, 1.0)
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        weight = weight * (factor * decay)
        size = np.bincount(np.searchsorted(ids, h), minlength=len(ids))
        scale = inverse[block] if both else np.zeros(len(block))
        diagonal = local[ids]

        def finish(lo: int, hi: int, acc: np.ndarray) -> np.ndarray:
            acc[(row[at[lo] : at[hi]] - lo) * len(block) + col[at[lo] : at[hi]]] += own[at[lo] : at[hi]]
            return (acc.reshape(hi - lo, len(block)) * (inverse[ids[lo:hi], None] + scale)).ravel()

        def known(lo: int, hi: int) -> np.ndarray:
            here = diagonal[lo:hi]
            return (np.arange(hi - lo) * len(block) + here)[here >= 0]

        found = list(_product(size, link, weight, ptr, columns, vals, len(block), n, digits, known, finish))
        return _table(found, names[ids], names[block])

    return run


def top_second_degree(obs: DataFrame, n: int, digits: int = 9, prune_ratio: float = 0.5, decay: float = 0.3, min_cooccurrence: float = 3, both: bool = True, on: str = "userid", of: str = "itemid") -> DataFrame:
    """(itemid_source, itemid, prediction): the n best per item of ``higher_degree`` 2, row-normalised (and symmetrised).

    Of the pruned matrix H with row sums r, the row sums of H H without diagonal are sum_m H[a,m] r[m] less
    sum_m H[a,m]^2, so the rescaling factor and every row's total are known before the square is made. Every block
    of rows of H meets every block of its columns, while an entry of C goes to its own two blocks only; no cell of the
    square leaves its task but the n best. The work is the
    number of paths of length two in H. A vocabulary over 64 MB takes the relational plan.
    """
    coded = co.coded_pairs(obs, on, of)
    if coded is None:
        sim = co.normalise_rows(co.higher_degree(co.cooccurrence(obs, on, of), 2, prune_ratio, decay, min_cooccurrence))
        return co.top_similar(co.symmetrise(sim) if both else sim, n, digits)
    names, buckets = coded.names, coded.buckets
    # Netted once: afterwards each bucket is one row, and no further step shuffles the pairs of C but the last.
    found = cut(co.by_bucket(coded.found, buckets).applyInArrow(_netted, "bucket int, keys binary, counts binary"), "pairs")
    bound = float(min_cooccurrence)
    if prune_ratio > 0:
        per = co.by_bucket(found, buckets).applyInArrow(_histogram, "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).orderBy("value").toPandas()  # one row a distinct count
        if len(per):
            upto, q = per["n"].cumsum().to_numpy(), int(100 * prune_ratio) / 100
            h = (upto[-1] - 1) * q
            lo, hi = (per["value"].to_numpy()[np.searchsorted(upto, i, side="right")] for i in (math.floor(h), math.ceil(h)))
            bound = max(bound, lo + (hi - lo) * (h - math.floor(h)))
    high = cut(found.mapInArrow(_at_least(bound), "bucket int, keys binary, counts binary"), "high")
    r, q, s = (np.zeros(len(names)) for _ in range(3))
    local = co.by_bucket(high, buckets).applyInArrow(_pruned_stats(bound), "code long, r double, q double").toArrow().to_pandas()  # one row a code
    r[local["code"]], q[local["code"]] = local["r"], local["q"]
    local = co.by_bucket(high, buckets).applyInArrow(_linked(bound, r), "code long, s double").toArrow().to_pandas()
    s[local["code"]] = local["s"]
    second = decay * (s - q)
    total = float(coded.totals.sum())
    factor = total / (float(r.sum() + second.sum()) + 1)
    inverse = 1 / np.maximum(coded.totals + factor * (r + second), LEAST)
    each = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    own = found.mapInArrow(_split_cells(buckets), "i int, j int, keys binary, counts binary").select(F.lit(0).alias("kind"), "i", "j", "keys", "counts")
    left = high.select(F.lit(1).alias("kind"), F.col("bucket").alias("i"), each.alias("j"), "keys", "counts")
    right = high.select(F.lit(2).alias("kind"), each.alias("i"), F.col("bucket").alias("j"), "keys", "counts")
    parts = min(2 * buckets * buckets, 4096)
    blocks = own.unionByName(left).unionByName(right).repartition(parts, "i", "j").groupBy("i", "j")
    best = blocks.applyInArrow(_square_block(names, inverse, bound, factor, decay, both, n, digits), "userid string, itemid string, prediction double")
    return re_.top_per_user(best, n, digits).withColumnRenamed("userid", "itemid_source")
