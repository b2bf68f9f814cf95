"""Splits that keep related records together.

Records that share a key value are linked; hash-to-min finds the connected
components of the links, and weighted rendezvous hashing sends each component to
a split. Clusters are kept as rows (node, neighbour), never as arrays, so a giant
component is many rows and not one record.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.hashing import unit_hash
from quern.functions.text import filled, folded
from quern.scratch import cut, release


def links(df: DataFrame, id_col: str, keys: Sequence[str]) -> DataFrame:
    """Edges (a, b): every id to the smallest id that has the same value of a key.

    Null keys and null ids link nothing. One row an id and key at most, whatever the
    size of the group.
    """
    edges = None
    for key in keys:
        rows = df.select(F.col(f"`{id_col}`").alias("a"), F.col(f"`{key}`").alias("k")).filter("a is not null and k is not null").distinct()
        lowest = rows.groupBy("k").agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
        own = rows.join(lowest, "k").filter("a <> b").select("a", "b")
        edges = own if edges is None else edges.unionByName(own)
    return edges.distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) by hash-to-min; the component is named by its smallest node.

    Each round every node sends its cluster to the cluster's minimum and the minimum
    to every member. Done when each cluster is a star around its minimum. Nodes
    without an edge do not appear; an empty edge table gives none; self loops and
    repeated edges are harmless.
    """
    edges = edges.toDF("a", "b").filter("a is not null and b is not null")
    row = lambda v, u: F.struct(F.col(v).alias("v"), F.col(u).alias("u"))
    pairs = F.array(row("a", "b"), row("b", "a"), row("a", "a"), row("b", "b"))
    cluster = cut(edges.select(F.explode(pairs).alias("p")).select("p.v", "p.u").distinct(), "clusters")
    for _ in range(max_rounds):
        low = cluster.groupBy("v").agg(F.min("u").alias("m"))
        seen = cluster.join(low, "v")
        if seen.filter("u <> m and v <> m").isEmpty():
            result = seen.groupBy(F.col("v").alias("node")).agg(F.min("m").alias("component"))
            result._quern_path = cluster._quern_path
            return result
        sent = F.array(row("m", "u"), row("u", "m"))
        after = cut(seen.select(F.explode(sent).alias("p")).select("p.v", "p.u").distinct(), "clusters")
        release(cluster)
        cluster = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def rendezvous(key: Column, weights: Mapping[str, float], seed: int = 7) -> Column:
    """The split for a key: each split draws a hashed number, the largest -w/ln(u) wins.

    Raising one split's weight moves keys only into that split.
    """
    draws = [F.struct((F.lit(float(w)) / -F.log(unit_hash(key, F.lit(name), seed=seed))).alias("score"), F.lit(name).alias("name")) for name, w in weights.items()]
    return F.greatest(*draws)["name"] if len(draws) > 1 else F.lit(next(iter(weights)))


def grouped_splits(df: DataFrame, id_col: str, keys: Sequence[str], weights: Mapping[str, float], seed: int = 7, component: str = "component", split: str = "split") -> DataFrame:
    """Every row with its component and split; rows that share a key value never part.

    Rows with a null id have no relations: their component is null and a hash of the
    whole row chooses the split. Repeated rows stay; an empty table stays empty; extra
    columns pass through. Links are kept only for ids with company, so the join back
    is against the related ids alone.
    """
    found = components(links(df, id_col, keys)).select(F.col("node").alias("__q_node"), F.col("component").alias("__q_comp"))
    own = F.col(f"`{id_col}`")
    joined = df.join(found, own == F.col("__q_node"), "left")
    comp = F.coalesce(F.col("__q_comp"), own)
    loose = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("string")  # of rows that are nobody's
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], comp.alias(component), rendezvous(F.coalesce(comp.cast("string"), loose), weights, seed).alias(split))


#: Folded notation of a person: gender and age in either order, occupation by name or code, zip code.
_PERSON = r"^(?:(m|male|f|female) (\d{1,3})|(\d{1,3}) (m|male|f|female)) (.+?) (\d[\d ]*)$"


def person_keys(userids: DataFrame, users: DataFrame) -> DataFrame:
    """(userid, person): the distinct non-blank userids and whom they state, however written.

    The person is gender, age, occupation code and seven-digit zip code; a userid that
    states less has a null person and is linked to nobody.
    """
    ids = userids.select("userid").distinct().filter(filled("userid"))
    text = folded("userid")
    part = lambda i: F.regexp_extract("t", _PERSON, i)
    told = ids.withColumn("t", text).select(
        "userid",
        F.substring(F.concat(part(1), part(4)), 1, 1).alias("gender"),
        F.concat(part(2), part(3)).try_cast("int").alias("age"),
        part(5).alias("occ"),
        F.replace(part(6), F.lit(" "), F.lit("")).alias("zip"),
    ).withColumn("zip", F.when(F.char_length("zip") < 7, F.lpad("zip", 7, "0")).otherwise(F.col("zip")))
    names = users.filter("occupation is not null and occupation_name is not null").select(folded("occupation_name").alias("occ"), F.col("occupation").cast("string").alias("code")).groupBy("occ").agg(F.min("code").alias("code"))
    code = F.when(F.col("occ").rlike(r"^\d+$"), F.coalesce(F.col("occ").try_cast("int").cast("string"), "occ")).otherwise(F.coalesce("code", "occ"))
    person = F.when(F.col("gender") != "", F.concat_ws("|", "gender", F.col("age").cast("string"), code, "zip"))
    return told.join(names, "occ", "left").select("userid", person.alias("person"))


def same_person_pairs(ratings: DataFrame, users: DataFrame) -> DataFrame:
    """(userid_a, userid_b): different userid strings of one component, the smaller first."""
    found = components(links(person_keys(ratings, users), "userid", ["person"]))
    a, b = found.toDF("userid_a", "component"), found.toDF("userid_b", "component")
    return a.join(b, "component").filter("userid_a < userid_b").select("userid_a", "userid_b")


def person_splits(ratings: DataFrame, users: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 7) -> DataFrame:
    """Every row of the ratings with its person's component and split.

    Rows of a blank userid are nobody's: their component is null and their itemid and time choose the split.
    """
    weights = weights or {"train": 0.8, "validation": 0.1, "test": 0.1}
    found = components(links(person_keys(ratings, users), "userid", ["person"])).select(F.col("node").alias("userid"), F.col("component").alias("__q_comp"))
    comp = F.when(filled("userid"), F.coalesce(F.col("__q_comp"), F.col("userid")))
    loose = F.concat_ws("|", "itemid", F.col("first_timestamp").cast("string"))
    return ratings.join(found, "userid", "left").select(*ratings.columns, comp.alias("component"), rendezvous(F.coalesce(comp, loose), weights, seed).alias("split"))


def related_texts(docs: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 7) -> DataFrame:
    """(doc_id, component, split) of documents; those by one author or with the same body never part, directly or through others.

    Blank authors and blank bodies relate nothing. Bodies meet by 128 hashed bits.
    """
    weights = weights or {"train": 0.8, "validation": 0.1, "test": 0.1}
    body = F.when(filled("text"), F.concat(F.hex(F.xxhash64("text")), F.hex(F.xxhash64("text", F.lit(1)))))
    rows = docs.filter("doc_id is not null").select("doc_id", F.when(filled("userid"), F.col("userid")).alias("author"), body.alias("body"))
    return grouped_splits(rows, "doc_id", ["author", "body"], weights, seed).select("doc_id", "component", "split")
