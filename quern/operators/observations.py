"""Typed observation tables and the relational operators over them.

An observation is (userid string, itemid string, rating double, ts). Functions take
and return DataFrames; extra columns pass through unless stated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.hashing import hashed, unit_hash
from quern.operators.positions import with_positions
from quern.operators.quantiles import quantiles
from quern.scratch import cut


def observations(df: DataFrame, user: str, item: str, rating: str, ts: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Typed columns, one row per (userid, itemid): the first by ts, then ``order``.

    The first row is kept by a min over a struct, so duplicates are reduced before the
    shuffle; rows without a time, or without one of the other keys, come after those with it.
    Null ids form pairs of their own, as in any grouping.
    """
    keys = ([ts] if ts else []) + [c for c in order if c != ts] + [rating]
    first = F.min(F.struct(*[c for k in dict.fromkeys(keys) for c in (F.col(k).isNull().alias(f"__q_no_{k}"), F.col(k))])).alias("f")
    whole = {c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint")}  # travel as numbers, text afterwards
    key = lambda c: F.col(c) if c in whole else F.col(c).cast("string")
    out = df.groupBy(key(user).alias("userid"), key(item).alias("itemid")).agg(first)
    cols = [F.col("userid").cast("string").alias("userid"), F.col("itemid").cast("string").alias("itemid"), F.col(f"f.{rating}").cast("double").alias("rating")]
    return out.select(*cols, *([F.col(f"f.{ts}").alias("ts")] if ts else []))


def union_first(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both, one per (userid, itemid); the left side wins."""
    both = left.withColumn("__q_p", F.lit(0)).unionByName(right.withColumn("__q_p", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("userid", "itemid", "__q_p")]
    return both.groupBy("userid", "itemid").agg(F.min(F.struct("__q_p", *rest)).alias("f")).select("userid", "itemid", *[F.col(f"f.{c}").alias(c) for c in rest])


def history_counts(obs: DataFrame, key: str) -> DataFrame:
    return obs.groupBy(key).agg(F.count("*").alias("n"))


def data_info(obs: DataFrame) -> DataFrame:
    """Rows, distinct users and items, 20th and 80th rating percentiles (exact, interpolated)."""
    p20, p80 = quantiles(obs, "rating", [0.2, 0.8]) or (None, None)
    out = obs.agg(F.count("*").alias("n_rows"), F.count_distinct("userid").alias("n_users"), F.count_distinct("itemid").alias("n_items"))
    return out.select("*", F.lit(p20).cast("double").alias("p20"), F.lit(p80).cast("double").alias("p80"))


def keep_known(obs: DataFrame, other: DataFrame) -> DataFrame:
    """Rows whose user is one of the other table's users and whose item one of its items."""
    return obs.join(other.select("userid").distinct(), "userid", "left_semi").join(other.select("itemid").distinct(), "itemid", "left_semi")


def filter_interactions(obs: DataFrame, other: DataFrame, mode: str) -> DataFrame:
    """Pairs of the other table removed (``remove``) or kept (``keep``); repeats multiply nothing."""
    how = {"remove": "left_anti", "keep": "left_semi"}.get(mode)
    if how is None:
        raise ValueError("mode must be 'remove' or 'keep'")
    return obs.join(other.select("userid", "itemid"), ["userid", "itemid"], how)


def filter_ids(obs: DataFrame, key: str, ids: Sequence[str] | str | DataFrame) -> DataFrame:
    """Rows whose id is in a short list (pushed to the scan) or in a table's first column."""
    if isinstance(ids, DataFrame):
        return obs.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    return obs.filter(F.col(key).isin([ids] if isinstance(ids, str) else list(ids)))


def sample_ids(obs: DataFrame, key: str, n: int | None, method: str = "top", min_hist: int = 0, keep: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """One column of ids: the n most frequent (ties by id) or n drawn by a seeded hash, plus ``keep``."""
    if method not in ("top", "random"):
        raise ValueError("method must be 'top' or 'random'")
    counts = history_counts(obs, key).filter(F.col("n") >= min_hist)
    order = F.col("n").desc() if method == "top" else hashed(key, seed=seed).asc()
    chosen = counts.orderBy(order, F.col(key).asc()).limit(n) if n is not None else counts
    out = chosen.select(key)
    if keep:
        out = out.unionByName(counts.filter(F.col(key).isin(list(keep))).select(key)).distinct()
    return out


def sample_observations(obs: DataFrame, n_users: int | None = None, n_items: int | None = None, method: str = "top", min_user_hist: int = 0, min_item_hist: int = 0, users_to_keep: Sequence[str] = (), items_to_keep: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Rows of chosen users and chosen items; thresholds look at the whole table's counts."""
    users = sample_ids(obs, "userid", n_users, method, min_user_hist, users_to_keep, seed)
    items = sample_ids(obs, "itemid", n_items, method, min_item_hist, items_to_keep, seed)
    return obs.join(users, "userid", "left_semi").join(items, "itemid", "left_semi")


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of the row."""
    return df.orderBy(hashed(*df.columns, seed=seed), *df.columns).limit(n)


def _latest(df: DataFrame, ts: str) -> DataFrame:
    return F.broadcast(df.agg(F.max(ts).alias("__q_last")))  # one row


def time_window(df: DataFrame, ts: str, days: tuple[int, int]) -> DataFrame:
    """Rows in (latest - max(days), latest - min(days)], typed comparison."""
    back = lambda d: F.col("__q_last") - F.make_dt_interval(F.lit(d))
    return df.crossJoin(_latest(df, ts)).filter((F.col(ts) > back(max(days))) & (F.col(ts) <= back(min(days)))).select(*df.columns)


def time_batches(df: DataFrame, ts: str, n: int, days: int = 1, out: str = "batch") -> DataFrame:
    """Batch 0 .. n-1, the earliest first; everything older falls into batch 0."""
    age = F.timestamp_diff("DAY", F.col(ts).cast("timestamp"), F.col("__q_last").cast("timestamp"))
    number = F.lit(n - 1) - F.least(F.lit(n - 1), F.floor(age / days).cast("int"))
    return df.crossJoin(_latest(df, ts)).select(*df.columns, number.alias(out))


def split_by_time(df: DataFrame, ts: str, ratio: float | None = None, n_samples: int | None = None, ties: Sequence[str] = (), out: str = "part") -> DataFrame:
    """'test' for the latest int((rows - 1) * ratio) rows, else 'train'; positions are exact and distributed."""
    if (ratio is None) == (n_samples is None):
        raise ValueError("give either ratio or n_samples")
    df = cut(df, "rows")  # counted, sampled and sorted
    rows = df.count()
    share = ratio if ratio is not None else n_samples / max(rows, 1)
    cutoff = int((rows - 1) * share)
    # Whole values of ts are placed by their counts; only the rows of the value at the edge need places of their own.
    counts = with_positions(df.groupBy(F.col(ts).alias("t")).agg(F.count("*").alias("n")), [], [F.col("t").desc()], out="upto", weight="n")
    edge = counts.filter((F.col("upto") >= cutoff) & (F.col("upto") - F.col("n") < cutoff)).select("t", (F.col("upto") - F.col("n")).alias("before"))
    found = edge.collect()  # one row, none for an empty test part
    if not found:
        return df.withColumn(out, F.lit("train"))
    at = F.broadcast(edge.select(F.col("t").alias("__q_t")))
    rows = df.crossJoin(at)
    same = F.col(ts).eqNullSafe(F.col("__q_t"))
    later = F.coalesce(F.col(ts) > F.col("__q_t"), F.col(ts).isNotNull())
    placed = with_positions(rows.filter(same).select(*df.columns), [], [F.col(c).asc() for c in ties], out="__q_n")
    part = lambda test: F.when(test, "test").otherwise("train").alias(out)
    return rows.filter(~same).select(*df.columns, part(later)).unionByName(placed.select(*df.columns, part(F.col("__q_n") <= cutoff - found[0].before)))


def hash_split(df: DataFrame, ratio: float, keys: Sequence[str], seed: int = 42, out: str = "part") -> DataFrame:
    """'test' for exactly ceil(ratio * rows) rows, drawn by a seeded hash of the keys."""
    df = cut(df, "rows")
    cutoff = -int(-(df.count() * ratio) // 1)
    placed = with_positions(df, [], [hashed(*keys, seed=seed).asc(), *[F.col(k).asc() for k in keys]], out="__q_n")
    return placed.select(*df.columns, F.when(F.col("__q_n") <= cutoff, "test").otherwise("train").alias(out))


def split_some_users(df: DataFrame, user_ratio: float, test_ratio: float, key: str = "userid", row: Sequence[str] = ("userid", "itemid"), seed: int = 42, out: str = "part") -> DataFrame:
    """Only rows of a hashed share of users can be test rows, each with the given chance; ``row`` names a row."""
    test = (unit_hash(key, seed=seed) < user_ratio) & (unit_hash(*row, seed=seed + 1) < test_ratio)
    return df.withColumn(out, F.when(test, "test").otherwise("train"))


def zero_ranks(df: DataFrame, group: str, score: str, tie: str, out: str = "rank") -> DataFrame:
    """0-based rank by score descending, ties by ``tie``; groups are result lists of bounded length."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie).asc())) - 1).cast("bigint"))


def to_lists(df: DataFrame, group: str, score: str, target: str, n: int) -> DataFrame:
    """(group, targets array, scores array) of the first n by score, then target."""
    top = zero_ranks(df, group, score, target, "__q_r").filter(F.col("__q_r") < n)
    rows = F.array_sort(F.collect_list(F.struct("__q_r", F.col(target), F.col(score)))).alias("l")
    return top.groupBy(group).agg(rows).select(group, F.col("l")[target].alias(target), F.col("l")[score].alias(score))


def from_lists(df: DataFrame, *lists: str) -> DataFrame:
    """One row per list element; the lists may differ in length (nulls fill), static columns stay."""
    static = [c for c in df.columns if c not in lists]
    return df.select(*static, F.explode(F.arrays_zip(*lists)).alias("z")).select(*static, *[F.col(f"z.{c}").alias(c) for c in lists])


def known_together(obs: DataFrame, items: DataFrame, key: str = "itemid") -> tuple[DataFrame, DataFrame]:
    """Observations of known items, and the items that are observed; both from the state before."""
    return obs.join(items.select(key).distinct(), key, "left_semi"), items.join(obs.select(key).distinct(), key, "left_semi")


def cluster_items(items: DataFrame, label: int, column: str = "cluster_label") -> DataFrame:
    """The items of one cluster or cell."""
    if column not in items.columns:
        raise ValueError(f"items have no column {column}")
    return items.filter(F.col(column) == label)


def items_of_user(obs: DataFrame, items: DataFrame, user: str) -> DataFrame:
    """The item rows of one user's distinct items."""
    return items.join(obs.filter(F.col("userid") == user).select("itemid").distinct(), "itemid", "left_semi")


def align_to(vocabulary: DataFrame, rows: DataFrame, key: str, code: str = "code") -> DataFrame:
    """One row for every code of a vocabulary (key, code), nulls where ``rows`` lacks the key, its smallest row where it has several."""
    rest = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("__q_f")).select(key, *[F.col(f"__q_f.{c}").alias(c) for c in rest])
    return vocabulary.select(key, code).join(one, key, "left")


def encode_ids(df: DataFrame, vocabularies: dict[str, DataFrame], drop_unseen: bool = True) -> DataFrame:
    """Adds <column>_code from vocabularies (value, code); rows with an unseen id go, or keep a null code."""
    for c, v in vocabularies.items():
        df = df.join(v.select(F.col("value").alias(c), F.col("code").alias(f"{c}_code")), c, "inner" if drop_unseen else "left")
    return df


def decode_ids(df: DataFrame, code: str, vocabulary: DataFrame, out: str) -> DataFrame:
    """The id of each code of a vocabulary (value, code)."""
    return df.join(vocabulary.select(F.col("code").alias(code), F.col("value").alias(out)), code, "left")


def join_scores(items: DataFrame, scores: DataFrame, key: str = "itemid", score: str = "prediction") -> DataFrame:
    """Every item with its score, the best first, those without one last."""
    return items.join(scores.select(key, score), key, "left").orderBy(F.col(score).desc_nulls_last(), F.col(key).asc())


def common_items(obs: DataFrame, item: str, least: int = 2) -> DataFrame:
    """(itemid, n): the items of all users of one item, with how many of these users have them, from ``least`` on."""
    users = obs.filter(F.col("itemid") == item).select("userid").distinct()
    return obs.join(users, "userid", "left_semi").groupBy("itemid").agg(F.count_distinct("userid").alias("n")).filter(F.col("n") >= least)


def users_of_any(*tests: DataFrame) -> DataFrame:
    """The distinct users of several test sets."""
    out = tests[0].select("userid")
    for t in tests[1:]:
        out = out.unionByName(t.select("userid"))
    return out.distinct()


def pair_sums(obs: DataFrame, value: str = "rating") -> DataFrame:
    """(userid, itemid, value) with repeated pairs added up; pairs with a null id are left out."""
    return obs.filter("userid is not null and itemid is not null").groupBy("userid", "itemid").agg(F.sum(F.col(value).cast("double")).alias(value))


def marker_sizes(df: DataFrame, score: str, out: str = "size", least: int = 5) -> DataFrame:
    """Squared scores moved to 0, scaled to 10 and raised by ``least``, as whole numbers; one size if all are equal."""
    sq = F.col(score) * F.col(score)
    bounds = F.broadcast(df.agg(F.min(sq).alias("__q_lo"), F.max(sq).alias("__q_hi")))  # one row
    share = F.coalesce((sq - F.col("__q_lo")) / F.nullif(F.col("__q_hi") - F.col("__q_lo"), F.lit(0.0)), F.lit(0.0))
    return df.crossJoin(bounds).select(*df.columns, F.floor(share * 10 + least).cast("int").alias(out))


def composite_key(*parts: str | Column, sep: str = "-") -> Column:
    return F.concat_ws(sep, *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts])


def token_flags(df: DataFrame, id_col: str, text_col: str, tokens: Sequence[str], sep: str = r"\|") -> DataFrame:
    """One 0/1 int column per token of a separated text, all tokens and not only the first."""
    words = F.split(F.col(text_col), sep)
    name = lambda t: t.replace("-", "").replace("'", "").replace(" ", "_").lower()
    return df.select(id_col, *[F.coalesce(F.array_contains(words, t), F.lit(False)).cast("int").alias(name(t)) for t in tokens])
