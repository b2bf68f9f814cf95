"""Item features: roles, encodings, bins, Gray codes, weights, in long form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.positions import with_positions
from quern.operators.quantiles import quantiles


def infer_roles(df: DataFrame, unique_ratio: float = 0.05, n_unique: int = 20) -> dict[str, str]:
    """Column to role: strings cat; one value dropped; two bin; few values cat; else num. One pass."""
    row = df.agg(F.count("*").alias("__q_n"), *[F.count_distinct(F.col(c)).alias(c) for c in df.columns]).first()
    if not row["__q_n"]:
        raise ValueError("no rows to infer roles from")
    roles = {}
    for f in df.schema.fields:
        n = row[f.name]
        if isinstance(f.dataType, T.StringType):
            roles[f.name] = "cat"
        elif n >= 2:
            roles[f.name] = "bin" if n == 2 else "cat" if n < n_unique or n / row["__q_n"] <= unique_ratio else "num"
    return roles


def roles_table(df: DataFrame, **kw) -> DataFrame:
    return df.sparkSession.createDataFrame(sorted(infer_roles(df, **kw).items()), "name string, role string")


def select_features(df: DataFrame, id_col: str, roles: Mapping[str, str], chosen: Sequence[str] | None = None) -> DataFrame:
    """The id and the columns that have a role, restricted to ``chosen`` unless that is empty."""
    return df.select(id_col, *[c for c in df.columns if c in roles and c != id_col and (not chosen or c in chosen)])


def split_roles(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A column that is both categorical and numeric is copied to <column>_num; the numeric names as they are then."""
    both = [c for c in numeric if c in set(categorical)]
    return df.withColumns({f"{c}_num": F.col(c) for c in both}), [f"{c}_num" if c in both else c for c in numeric]


class Featuriser:
    """Roles, bins and encodings learnt from items once and applied to any rows with the same columns."""

    def __init__(self, id_col: str = "itemid", n_bins: int = 32, weights: float | Mapping[str, float] = 1.0, spillage: int = 0, mode: str = "binarise", unique_ratio: float = 0.05, n_unique: int = 20) -> None:
        if mode not in ("binarise", "numeric", "gray"):
            raise ValueError("mode must be 'binarise', 'numeric' or 'gray'")
        self.id_col, self.n_bins, self.weights, self.spillage, self.mode = id_col, n_bins, weights, spillage, mode
        self.unique_ratio, self.n_unique = unique_ratio, n_unique

    def fit(self, items: DataFrame, chosen: Sequence[str] | None = None) -> Featuriser:
        """Numbers get quantile edges, or their range with mode 'numeric'."""
        own = items.select(*[c for c in items.columns if c != self.id_col and (not chosen or c in chosen)])
        self.roles = infer_roles(own, self.unique_ratio, self.n_unique)
        self.edges = {c: quantile_edges(items, c, self.n_bins) for c, r in self.roles.items() if r == "num"}
        return self

    def transform(self, items: DataFrame, identity: bool = False, normalise: bool = False) -> DataFrame:
        """(itemid, feature, weight) rows; nulls are filled by type, identity adds 'id=item'."""
        cat = [c for c, r in self.roles.items() if r != "num"]
        filled = fill_by_type(items.select(self.id_col, *self.roles), self.id_col)
        parts = [one_hot(filled, self.id_col, cat)] if cat else []
        for c, edges in self.edges.items():
            rows = filled.select(F.col(self.id_col).alias("itemid"), F.col(c).cast("double").alias("x"))
            if self.mode == "numeric":
                parts.append(rows.select("itemid", F.lit(c).alias("feature"), F.col("x").alias("weight")))
                continue
            n = max(1, len(edges) - 1)
            binned = rows.select("itemid", bin_column(F.col("x"), edges, "min").alias("bin"))
            if self.mode == "gray":
                bits = F.explode(F.array(*[F.struct(F.lit(f"{c}=bit{j}").alias("feature"), b.cast("double").alias("weight")) for j, b in enumerate(gray_bits(F.col("bin"), n))])).alias("b")
                parts.append(binned.select("itemid", bits).select("itemid", "b.feature", "b.weight").filter("weight <> 0"))
            else:
                parts.append(spill(binned, n, self.spillage).select("itemid", F.concat(F.lit(f"{c}="), F.col("feature_bin").cast("string")).alias("feature"), "weight"))
        out = weigh(reduce(DataFrame.unionByName, parts), self.weights)
        out = normalise_l1(out) if normalise else out
        return add_identity(out) if identity else out


def encode_labels(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """(value, code): 0-based position among the sorted distinct values, numbered in parallel."""
    values = df.select(F.col(col).alias("value")).filter("value is not null").distinct()
    return with_positions(values, [], [F.col("value").asc()], out="__q_p").select("value", (F.col("__q_p") - 1).alias(out))


def fill_by_type(df: DataFrame, id_col: str) -> DataFrame:
    """Null numbers and booleans become 0 or false, null text '.'."""
    def fill(f: T.StructField) -> Column:
        c = F.col(f.name)
        if f.name == id_col:
            return c
        if isinstance(f.dataType, T.StringType):
            return F.coalesce(c, F.lit(".")).alias(f.name)
        return F.coalesce(c, F.lit(0).cast(f.dataType)).alias(f.name)

    return df.select(*[fill(f) for f in df.schema.fields])


def one_hot(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """(itemid, feature 'col=value', weight 1) per row and column; nulls are filled by type first."""
    rows = F.explode(F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in cols])).alias("feature")
    return fill_by_type(df.select(id_col, *cols), id_col).select(F.col(id_col).alias("itemid"), rows, F.lit(1.0).alias("weight"))


def quantile_edges(df: DataFrame, col: str, n_bins: int) -> list[float]:
    """Percentiles 1/n .. n/n, or n + 1 equally wide edges where these are not distinct; none without numbers."""
    found = quantiles(df, col, [0.0, *[(i + 1) / n_bins for i in range(n_bins)]])
    if not found:
        return []
    edges = found[1:]
    if len(set(edges)) == len(edges):
        return edges
    low, high = found[0] - 0.001, found[-1] + 0.001
    return [low + (high - low) * i / n_bins for i in range(n_bins + 1)]


def bin_column(col: Column, edges: Sequence[float], missing: str | float | None = None) -> Column:
    """0-based right-closed bin; values outside the fitted range fall into the first or last bin.

    Null and NaN have no bin, or with ``missing='min'`` the first one, or that of the number ``missing``.
    """
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<double>")
    place = lambda x: F.size(F.filter(inner, lambda e: e < x)).cast("long")
    known = F.when(col.isNotNull() & ~F.isnan(col.cast("double")), place(col))
    if missing is None:
        return known
    return F.coalesce(known, F.lit(0).cast("long") if missing == "min" else place(F.lit(float(missing))))


def spill(df: DataFrame, n_bins: int, spillage: int, bin_col: str = "bin") -> DataFrame:
    """Weight 1 at the bin and 1/2, 1/4 .. at its neighbours; (.., feature_bin, weight)."""
    at = F.explode(F.sequence(F.greatest(F.col(bin_col) - spillage, F.lit(0)), F.least(F.col(bin_col) + spillage, F.lit(n_bins - 1).cast("long"))))
    return df.select("*", at.alias("feature_bin")).withColumn("weight", F.pow(F.lit(2.0), -F.abs(F.col("feature_bin") - F.col(bin_col))))


def gray_bits(bin_col: Column, n_bins: int) -> list[Column]:
    """Bits of the Gray code of a bin number, lowest first."""
    code = bin_col.bitwiseXOR(F.shiftright(bin_col, 1))
    width = max(1, (n_bins - 1).bit_length())
    return [F.shiftright(code, j).bitwiseAND(F.lit(1).cast("long")) for j in range(width)]


def weigh(features: DataFrame, weights: float | Mapping[str, float]) -> DataFrame:
    """Scales weights by a number, or by the first entry whose key begins the feature's name."""
    if isinstance(weights, (int, float)):
        factor: Column = F.lit(float(weights))
    else:
        hits = [F.when(F.startswith(F.col("feature"), F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        factor = F.coalesce(*hits, F.lit(1.0))
    return features.withColumn("weight", F.col("weight") * factor)


def normalise_l1(features: DataFrame, by: str = "itemid") -> DataFrame:
    sums = features.groupBy(by).agg(F.sum(F.abs("weight")).alias("__q_t"))
    return features.join(sums, by).withColumn("weight", F.col("weight") / F.nullif(F.col("__q_t"), F.lit(0.0))).drop("__q_t")


def add_identity(features: DataFrame) -> DataFrame:
    own = features.select("itemid").distinct().select("itemid", F.concat(F.lit("id="), "itemid").alias("feature"), F.lit(1.0).alias("weight"))
    return features.unionByName(own)


def split_json(df: DataFrame, col: str, schema: str, drop: bool = True) -> DataFrame:
    """JSON text to columns; text that is no object gives nulls."""
    out = df.withColumn("__q_j", F.from_json(col, schema))
    kept = [c for c in df.columns if not (drop and c == col)]
    return out.select(*kept, "__q_j.*")


def union_flags(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
