"""Items that appear together: an incremental pair table.

The table keeps, for every pair of items, the number of baskets that hold both
(and, on the diagonal, each item's own number), in hash buckets. A batch of new
rows changes some baskets; a basket that grows emits its new pairs with +1, one
that becomes too long for the table its old pairs with -1. Deltas are netted in
the emitting task, sent as sorted delta-coded blocks (about 3 bytes a pair) and
appended as one run per batch, so a small batch writes little; runs are merged
when read, and compacted, with more buckets as the table grows, when there are
many. Association scores are kept too: a batch rescores the pairs it changed and
those whose items' own numbers it changed, and appends these rows only.

Pair emission and merging run on numpy over Arrow batches: sorting packed
integers there costs a fraction of exploding rows through a hash aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.packed import decode, encode, net
from quern.functions.text import filled
from quern.operators.positions import with_positions
from quern.scratch import cut, new_path, release, remove

FLUSH = 4_000_000  # packed pairs a task nets at once (32 MB and its sorted copy)
BUCKET_PAIRS = 2_000_000  # pairs aimed at in a bucket
CHUNK = 2_048  # items of a longer basket that one task pairs with as many others
RUNS = 8  # runs before they are compacted
BROADCAST_BYTES = 64 << 20


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the first item and the second one's range, so no single item fills a bucket."""
    mix = (keys >> 32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + ((keys & 0xFFFFFFFF) >> 16).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mix ^= mix >> np.uint64(32)
    return (mix % np.uint64(buckets)).astype(np.int32)  # a power of two, so that doubling splits every bucket


def blocks(keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row a bucket: its sorted keys and counts, coded."""
    own = bucket_of(keys, buckets)
    order = np.argsort(own, kind="stable")
    own, keys, counts = own[order], keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    coded = [encode(keys[i:j], counts[i:j]) for i, j in zip(at, np.append(at[1:], len(own)))]
    return pa.RecordBatch.from_arrays([pa.array(own[at], pa.int32()), pa.array([c[0] for c in coded], pa.binary()), pa.array([c[1] for c in coded], pa.binary())], names=["bucket", "keys", "counts"])


def _column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and lengths of a list column; null lists are empty."""
    col = batch.column(name)
    size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(size) - size, size


def ragged(left: np.ndarray, start: np.ndarray, count: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index into left, packed pair) of every left[i] with right[start[i] .. start[i] + count[i]], in slices of about FLUSH."""
    ends = np.cumsum(count)
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + FLUSH, side="right")))
        n = count[at:to]
        who = np.repeat(np.arange(at, to), n)
        x, y = left[who], right[np.arange(int(n.sum())) + np.repeat(start[at:to] - (np.cumsum(n) - n), n)]
        yield who, (np.minimum(x, y) << 32) | np.maximum(x, y)
        at = to


def emitter(buckets: int):
    """mapInArrow: rows (l, r, sign) to netted signed blocks.

    A row without r stands for all pairs a <= b of the sorted list l, one with r for every
    item of l with every item of r.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        amount = 0

        def flush() -> pa.RecordBatch:
            keys, signs = np.concatenate([k for k, _ in held]), np.concatenate([s for _, s in held])
            return blocks(*net(keys, None if (signs == 1).all() else signs.astype(np.int64)), buckets)

        for batch in batches:
            own, begin, size = _column(batch, "l")
            other, first, many = _column(batch, "r")
            cross = batch.column("r").is_valid().to_numpy(zero_copy_only=False)
            sign = batch.column("sign").to_numpy(zero_copy_only=False).astype(np.int8)
            row = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(own)) - begin[row]
            for kind, start, count, right in ((~cross, begin[row] + place, size[row] - place, own), (cross, first[row], many[row], other)):
                pick = np.flatnonzero(kind[row])
                for who, keys in ragged(own[pick], start[pick], count[pick], right):
                    held.append((keys, sign[row[pick[who]]]))
                    amount += len(keys)
                    if amount >= FLUSH:
                        yield flush()
                        held, amount = [], 0
        if held:
            yield flush()

    return run


def _blocks_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [decode(k, c) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist())]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ones = all((c == 1).all() for _, c in parts)
    return net(np.concatenate([k for k, _ in parts]), None if ones else np.concatenate([c for _, c in parts]))


def netter(table: pa.Table) -> pa.Table:
    """applyInArrow over one bucket of one batch: one block."""
    keys, sums = _blocks_of(table)
    coded = encode(keys, sums)
    return pa.table({"bucket": table.column("bucket")[:1], "keys": pa.array([coded[0]], pa.binary()), "counts": pa.array([coded[1]], pa.binary())})


def recoder(buckets: int):
    """mapInArrow: stored blocks to blocks of a larger number of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                keys, sums = decode(k, c)
                if len(keys):
                    yield blocks(keys, sums, buckets)

    return run


def changer(min_pair: int):
    """applyInArrow over one bucket of all runs: the pairs of the newest run that reach min_pair now or did before.

    Rows are (a, b, n); items' own numbers (a = b) are always among them.
    """

    def run(table: pa.Table) -> pa.Table:
        fresh = table.column("fresh").to_numpy(zero_copy_only=False).astype(bool)
        last, delta = _blocks_of(table.filter(pa.array(fresh)))
        old, counts = _blocks_of(table.filter(pa.array(~fresh)))
        at = np.searchsorted(old, last)
        had = np.zeros(len(last), np.int64)
        inside = at < len(old)
        inside[inside] = old[at[inside]] == last[inside]
        had[inside] = counts[at[inside]]
        now = had + delta
        a, b = last >> 32, last & 0xFFFFFFFF
        keep = (np.maximum(had, now) >= min_pair) | (a == b)
        return pa.table({"a": a[keep].astype(np.int32), "b": b[keep].astype(np.int32), "n": now[keep]})

    return run


def lister(table: pa.Table) -> pa.Table:
    """applyInArrow over one bucket of all runs: (a, b, n) of every pair."""
    keys, sums = _blocks_of(table)
    return pa.table({"a": (keys >> 32).astype(np.int32), "b": (keys & 0xFFFFFFFF).astype(np.int32), "n": sums})


@dataclass
class PairTable:
    """Persistent pair counts over baskets of (basket, item) rows.

    ``path`` holds the tables (a new folder of the shared folder by default).
    Baskets of more than ``max_basket`` items are left out, exactly, and stay out; None
    leaves out none: longer baskets are cut into chunks whose pairs are spread over tasks.
    Scores are kept for pairs of at least ``min_pair`` baskets; counts for all pairs.
    """

    spark: SparkSession
    path: str = ""
    max_basket: int | None = 250
    min_pair: int = 1
    buckets: int = 0
    version: int = 0
    n_items: int = 0
    n_baskets: int = 0
    vocabulary: list[DataFrame] = field(default_factory=list)
    members: list[DataFrame] = field(default_factory=list)
    runs: list[DataFrame] = field(default_factory=list)
    run_pairs: list[int] = field(default_factory=list)
    own: list[DataFrame] = field(default_factory=list)
    scored: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.path = self.path or new_path(self.spark, "pair-table")

    def apply(self, rows: DataFrame) -> PairTable:
        """Take in a batch of (basket, item) rows; blank or null ids and repeats count for nothing."""
        rows = rows.toDF("basket", "item").filter(filled("basket") & filled("item"))
        self.version += 1
        at = f"{self.path}/v{self.version}"
        fresh = self._new_members(rows, at)
        pieces, emitted = self._pieces(fresh, at)
        if not self.buckets:
            self.buckets = 1 << max(0, round(math.log2(max(1.0, emitted / BUCKET_PAIRS))))
        kind = "bucket int, keys binary, counts binary"
        raw = pieces.mapInArrow(emitter(self.buckets), kind)
        run = cut(self._by_bucket(raw).applyInArrow(netter, kind), "pairs", f"{at}/pairs")
        self._rescore(run, at)
        self.runs.append(run)
        self.run_pairs.append(emitted)
        if len(self.runs) > RUNS or self.run_pairs[0] > 0 and sum(self.run_pairs[1:]) > 2 * self.run_pairs[0]:
            self._compact(at)
        return self

    def _by_bucket(self, df: DataFrame):
        return df.repartition(min(self.buckets, 4096), "bucket").groupBy("bucket")

    def _new_members(self, rows: DataFrame, at: str) -> DataFrame:
        """(basket, code) pairs that the table has not seen, appended to its members; new items get the next codes."""
        items = rows.select("item").distinct()
        for known in self.vocabulary:
            items = items.join(known, "item", "left_anti")
        placed = with_positions(items, [], [F.col("item").asc()], out="p")
        self.vocabulary.append(cut(placed.select("item", (F.col("p") - 1 + self.n_items).cast("int").alias("code")), "vocabulary", f"{at}/vocabulary"))
        release(placed)
        self.n_items += self.vocabulary[-1].count()
        words = union(self.vocabulary)
        bound = words.agg(F.sum(F.octet_length("item") + 48)).first()[0] or 0
        pairs = rows.join(F.broadcast(words) if bound <= BROADCAST_BYTES else words, "item").select("basket", "code").distinct()
        if self.members:
            pairs = pairs.join(union(self.members), ["basket", "code"], "left_anti")
        fresh = cut(pairs, "members", f"{at}/members")
        self.members.append(fresh)
        return fresh

    def _pieces(self, fresh: DataFrame, at: str) -> tuple[DataFrame, int]:
        """(l, r, sign) rows of the pairs that the batch adds or takes away, and about how many they are.

        Of a basket within the bound its new items are paired with each other and with the old ones;
        of one that passes the bound only the old items, at most ``max_basket``, are read.
        """
        top = self.max_basket
        rows = fresh.withColumn("new", F.lit(True))
        if len(self.members) > 1:
            changed = fresh.select("basket").distinct()
            rows = rows.unionByName(union(self.members[:-1]).join(changed, "basket", "left_semi").withColumn("new", F.lit(False)))
        sizes = cut(rows.groupBy("basket").agg(F.count("*").alias("n"), F.count_if("new").alias("k")), "sizes")
        had, fits = F.col("n") - F.col("k"), F.lit(True) if top is None else F.col("n") <= top
        was = (had > 0) if top is None else (had > 0) & (had <= top)
        within = F.col("k") * (F.col("k") + 1) / 2 + F.col("k") * had
        facts = sizes.agg(F.sum(F.when(fits, within).when(was, had * (had + 1) / 2)), F.count_if(fits & (had == 0)), F.count_if(was & ~fits)).first()
        self.n_baskets += facts[1] - facts[2]
        live = sizes.filter(fits | was).select("basket", fits.alias("fits"), (F.col("n") > CHUNK).alias("long") if top is None else F.lit(False).alias("long"))
        rows = rows.join(live, "basket").filter(F.col("fits") | ~F.col("new"))
        none = F.lit(None).cast("array<int>")
        lists = rows.filter(~F.col("long")).groupBy("basket").agg(F.first("fits").alias("fits"), F.array_sort(F.collect_list(F.when(F.col("new"), F.col("code")))).alias("add"), F.array_sort(F.collect_list(F.when(~F.col("new"), F.col("code")))).alias("old"))
        piece = lambda left, right, sign: F.struct(left.alias("l"), right.alias("r"), F.lit(sign).cast("tinyint").alias("sign"))
        grown = F.array(piece(F.col("add"), none, 1), piece(F.col("add"), F.col("old"), 1))
        out = lists.select(F.explode(F.when(F.col("fits"), grown).otherwise(F.array(piece(F.col("old"), none, -1)))).alias("x")).select("x.*")
        if top is None:
            out = out.unionByName(self._long(rows.filter("long").select("basket", "code", "new")))
        return out, int(facts[0] or 0)

    def _long(self, rows: DataFrame) -> DataFrame:
        """The pieces of baskets over CHUNK items: every new chunk with itself, the later new ones and the old ones."""
        placed = with_positions(rows, ["basket", "new"], [F.col("code").asc()], out="p")
        chunks = placed.groupBy("basket", "new", F.floor((F.col("p") - 1) / CHUNK).alias("c")).agg(F.array_sort(F.collect_list("code")).alias("codes"))
        chunks = cut(chunks, "chunks")
        a = chunks.filter("new").select("basket", F.col("c").alias("i"), F.col("codes").alias("l"))
        b = chunks.select("basket", "new", F.col("c").alias("j"), F.col("codes").alias("r"))
        met = a.join(b, "basket").filter("not new or i <= j")
        return met.repartition("basket", "i", "j", "new").select("l", F.when(F.col("new") & (F.col("i") == F.col("j")), None).otherwise(F.col("r")).alias("r"), F.lit(1).cast("tinyint").alias("sign"))

    def _rescore(self, run: DataFrame, at: str) -> None:
        """Appends the own numbers and the scores that the newest run changes."""
        every = run.withColumn("fresh", F.lit(True))
        for old in self.runs:
            every = every.unionByName(old.join(run.select("bucket"), "bucket", "left_semi").withColumn("fresh", F.lit(False)))
        found = cut(self._by_bucket(every).applyInArrow(changer(self.min_pair), "a int, b int, n long"), "changed", f"{at}/changed")
        v = F.lit(self.version)
        self.own.append(cut(found.filter("a = b").select(F.col("a").alias("code"), "n", v.alias("v")), "own", f"{at}/own"))
        pairs = found.filter("a < b").select("a", "b", "n")
        if self.scored:
            touched = self.own[-1].select("code")
            old = self._scored().select("a", "b", "n")
            moved = old.join(touched.toDF("a"), "a", "left_semi").unionByName(old.join(touched.toDF("b"), "b", "left_semi").select("a", "b", "n")).distinct()
            pairs = pairs.unionByName(moved.join(pairs, ["a", "b"], "left_anti"))
        own = latest(union(self.own), ["code"], ["n"])
        bound = own.count() * 24
        side = lambda x: (F.broadcast(own) if bound <= BROADCAST_BYTES else own).select(F.col("code").alias(x), F.col("n").alias(f"n_{x}"))
        new = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n", "n_a", "n_b", v.alias("v"))
        self.scored.append(cut(new, "scores", f"{at}/scores"))
        release(found)

    def _scored(self) -> DataFrame:
        rows = latest(union(self.scored), ["a", "b"], ["n", "n_a", "n_b"]) if len(self.scored) > 1 else self.scored[0].drop("v")
        return rows.filter(F.col("n") >= max(1, self.min_pair))

    def _compact(self, at: str) -> None:
        """One run of netted counts, in more buckets where the table has grown, and one table of scores and own numbers."""
        pairs = sum(self.run_pairs)
        before = self.buckets
        self.buckets = max(before, 1 << max(0, round(math.log2(max(1.0, pairs / BUCKET_PAIRS)))))
        kind = "bucket int, keys binary, counts binary"
        every = union(self.runs)
        if self.buckets != before:
            every = every.mapInArrow(recoder(self.buckets), kind)
        run = cut(self._by_bucket(every).applyInArrow(netter, kind), "pairs", f"{at}/compact")
        own = cut(latest(union(self.own), ["code"], ["n"]).withColumn("v", F.lit(self.version)), "own", f"{at}/compact-own")
        scored = cut(self._scored().withColumn("v", F.lit(self.version)), "scores", f"{at}/compact-scores")
        members = cut(union(self.members), "members", f"{at}/compact-members")
        release(*self.runs, *self.own, *self.scored, *self.members)
        self.runs, self.own, self.scored, self.members, self.run_pairs = [run], [own], [scored], [members], [pairs]

    def counts(self) -> DataFrame:
        """(a, b, n) of item codes, a <= b; a = b is the item's own number of baskets."""
        return self._by_bucket(union(self.runs)).applyInArrow(lister, "a int, b int, n long")

    def scores(self, min_pair: int = 1, min_overlap: float = 0.0, min_lift: float = 0.0) -> DataFrame:
        """(item_a, item_b, n_ab, n_a, n_b, lift) of the pairs that pass, the smaller item first.

        The lift is n_ab * N / (n_a * n_b) with N baskets; the overlap is n_ab over the
        larger of n_a and n_b. Pairs below the table's own ``min_pair`` have no score.
        """
        if min_pair < self.min_pair:
            raise ValueError("scores are kept from the table's min_pair on")
        lift = F.col("n") * F.lit(float(self.n_baskets)) / (F.col("n_a").cast("double") * F.col("n_b"))
        rows = self._scored().filter(F.col("n") >= min_pair).withColumn("lift", lift)
        kept = rows.filter((F.col("n") >= min_overlap * F.greatest("n_a", "n_b")) & (F.col("lift") >= min_lift))
        words = union(self.vocabulary)
        kept = kept.join(words.toDF("i_a", "a"), "a").join(words.toDF("i_b", "b"), "b")
        swap = F.col("i_a") > F.col("i_b")
        pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
        return kept.select(pick("i_a", "i_b").alias("item_a"), pick("i_b", "i_a").alias("item_b"), F.col("n").alias("n_ab"), pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "lift")


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def latest(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Of the rows of a key, the one of the highest version v."""
    best = F.max(F.struct("v", *values)).alias("x")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"x.{c}").alias(c) for c in values])


def item_pairs(ratings: DataFrame, max_basket: int | None = 250, min_pair: int = 1) -> PairTable:
    """The pair table of ratings that arrive in two batches: what was loaded in the earlier half of the time, and the rest."""
    at = F.unix_micros(F.col("loaded_at").cast("timestamp"))
    first, last = ratings.agg(F.min(at), F.max(at)).first()
    early = F.coalesce(at < ((first or 0) + (last or 0)) // 2, F.lit(False))
    held = PairTable(ratings.sparkSession, max_basket=max_basket, min_pair=min_pair)
    return held.apply(ratings.filter(early).select("userid", "itemid")).apply(ratings.filter(~early).select("userid", "itemid"))
