"""Queries over the interaction-analytics operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import cooccurrence as co
from quern.operators import ensembles as en
from quern.operators import features as fe
from quern.operators import metrics as me
from quern.operators import models as mo
from quern.operators import observations as ob
from quern.operators import recommend as re_
from quern.operators import recommenders as rc
from quern.operators import scoring as sc
from quern.operators import similarity as si
from quern.plans import views
from quern.plans.tables import table
from quern.plans.views import OBS_SQL, PLACES_SQL, RATINGS_SQL
from quern.functions.hashing import hashed_sql, unit_hash_sql
from quern.operators.quantiles import quantiles
from quern.scratch import cut
from quern.streaming import events as ev

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TIES = ("userid", "itemid")

# Observations


@query(f"with {RATINGS_SQL} select userid, itemid, rating, ts from obs")
def obs_dedup(s: SparkSession, d: str) -> DataFrame:
    return views.ratings(s, d)


@query(f"with {RATINGS_SQL} select count(*) n_rows, count(distinct userid) n_users, count(distinct itemid) n_items, round(quantile_cont(rating, 0.2), 6) p20, round(quantile_cont(rating, 0.8), 6) p80 from obs")
def data_info(s: SparkSession, d: str) -> DataFrame:
    return ob.data_info(views.ratings(s, d)).withColumns({c: F.round(c, 6) for c in ("p20", "p80")})


@query(f"with {RATINGS_SQL} select userid, count(*) n from obs group by userid")
def users_history_counts(s: SparkSession, d: str) -> DataFrame:
    return ob.history_counts(views.ratings(s, d), "userid")


@query(f"with {RATINGS_SQL} select itemid, count(*) n from obs group by itemid")
def items_history_counts(s: SparkSession, d: str) -> DataFrame:
    return ob.history_counts(views.ratings(s, d), "itemid")


_HALF = f"{RATINGS_SQL}, mid as (select quantile_cont(ts, 0.1) m from obs), early as (select obs.* from obs, mid where ts <= m)"


def _early(obs: DataFrame) -> DataFrame:
    found = quantiles(obs, "ts", [0.1])
    return obs.filter(F.col("ts") <= (found[0] if found else 0.0))


@query(f"with {_HALF} select obs.* from obs where userid in (select userid from early) and itemid in (select itemid from early)")
def filter_columns_semi(s: SparkSession, d: str) -> DataFrame:
    o = cut(views.ratings(s, d), "obs")
    return ob.keep_known(o, _early(o)).select("userid", "itemid", "rating", "ts")


@query(f"with {_HALF} select obs.* from obs anti join early using (userid, itemid)")
def filter_interactions_remove(s: SparkSession, d: str) -> DataFrame:
    o = cut(views.ratings(s, d), "obs")
    return ob.filter_interactions(o, _early(o), "remove").select("userid", "itemid", "rating", "ts")


@query(f"with {_HALF} select obs.* from obs semi join early using (userid, itemid)")
def filter_interactions_keep(s: SparkSession, d: str) -> DataFrame:
    o = cut(views.ratings(s, d), "obs")
    return ob.filter_interactions(o, _early(o), "keep").select("userid", "itemid", "rating", "ts")


@query(f"""with {RATINGS_SQL}, u as (select userid from obs group by userid having count(*) >= 5 order by count(*) desc, userid limit 200),
i as (select itemid from obs group by itemid having count(*) >= 5 order by count(*) desc, itemid limit 300)
select obs.* from obs where userid in (select userid from u) and itemid in (select itemid from i)""")
def sample_top_users_items(s: SparkSession, d: str) -> DataFrame:
    return ob.sample_observations(views.ratings(s, d), 200, 300, "top", 5, 5).select("userid", "itemid", "rating", "ts")


@query("select event_id, user_id::varchar userid, ts from events, (select max(ts) m from events) where ts > m - interval 7 day and ts <= m - interval 2 day")
def time_window_filter(s: SparkSession, d: str) -> DataFrame:
    return ob.time_window(views.events(s, d), "ts", (2, 7)).select("event_id", "userid", "ts")


@query("""select event_id, case when row_number() over (order by ts desc, event_id) <= cast(floor(((select count(*) from events) - 1) * 0.2) as bigint) then 'test' else 'train' end part from events""")
def split_by_time_ratio(s: SparkSession, d: str) -> DataFrame:
    return ob.split_by_time(views.events(s, d).select("event_id", "ts"), "ts", ratio=0.2, ties=("event_id",)).select("event_id", "part")


@query("select event_id, cast(4 - least(4, floor(date_sub('day', ts, m) / 2)) as int) batch from events, (select max(ts) m from events)")
def time_batches(s: SparkSession, d: str) -> DataFrame:
    return ob.time_batches(views.events(s, d), "ts", 5, 2).select("event_id", "batch")


@query(f"""with {_HALF}, late as (select userid, itemid, rating + 1 rating, ts from obs)
select coalesce(e.userid, l.userid) userid, coalesce(e.itemid, l.itemid) itemid, coalesce(e.rating, l.rating) rating from late l full join early e using (userid, itemid)""")
def obs_union_dedup(s: SparkSession, d: str) -> DataFrame:
    o = cut(views.ratings(s, d), "obs")
    return ob.union_first(_early(o), o.withColumn("rating", F.col("rating") + 1)).select("userid", "itemid", "rating")


@query(f"with {RATINGS_SQL} select *, case when row_number() over (order by {hashed_sql('userid', 'itemid')}, userid, itemid) <= (select ceil(0.2 * count(*)) from obs) then 'test' else 'train' end part from obs")
def hash_split(s: SparkSession, d: str) -> DataFrame:
    return ob.hash_split(views.ratings(s, d), 0.2, _TIES)


@query(f"with {RATINGS_SQL} select *, case when {unit_hash_sql('userid')} < 0.2 and {unit_hash_sql('userid', 'itemid', seed=43)} < 0.2 then 'test' else 'train' end part from obs")
def split_some_users(s: SparkSession, d: str) -> DataFrame:
    return ob.split_some_users(views.ratings(s, d), 0.2, 0.2)


@query(f"with {RATINGS_SQL} select obs.* from obs where itemid in (select itemid from readable_movies)")
def known_items(s: SparkSession, d: str) -> DataFrame:
    return ob.known_together(views.ratings(s, d), views.movies(s, d))[0].select("userid", "itemid", "rating", "ts")


@query(f"with {RATINGS_SQL} select item_ind, itemid from readable_movies where itemid in (select itemid from obs)")
def observed_items(s: SparkSession, d: str) -> DataFrame:
    return ob.known_together(views.ratings(s, d), views.movies(s, d))[1].select("item_ind", "itemid")


@query(f"with {RATINGS_SQL}, top as (select userid from obs group by userid order by count(*) desc, userid limit 1) select item_ind, itemid from readable_movies where itemid in (select itemid from obs where userid = (select userid from top))")
def items_of_user(s: SparkSession, d: str) -> DataFrame:
    """The movies of the user with the longest history."""
    o = cut(views.ratings(s, d), "obs")
    top = ob.sample_ids(o, "userid", 1).first()
    return ob.items_of_user(o, views.movies(s, d), top[0] if top else "").select("item_ind", "itemid")


@query(f"with {RATINGS_SQL}, v as (select itemid, row_number() over (order by itemid) - 1 code from (select distinct itemid from obs)), m as (select * from (select *, row_number() over (partition by itemid order by item_ind nulls first) k from readable_movies) where k = 1) select v.itemid, v.code, m.item_ind from v left join m using (itemid)")
def align_items(s: SparkSession, d: str) -> DataFrame:
    """Every rated item's code with its features' row, nulls where it has none."""
    codes = fe.encode_labels(views.ratings(s, d), "itemid").toDF("itemid", "code")
    return ob.align_to(codes, views.movies(s, d).select("itemid", "item_ind"), "itemid").select("itemid", "code", "item_ind")


@query(f"with {RATINGS_SQL}, top as (select itemid from obs group by itemid order by count(*) desc, itemid limit 1) select itemid, count(*) n from obs where userid in (select userid from obs where itemid = (select itemid from top)) group by itemid having count(*) >= 2")
def common_items(s: SparkSession, d: str) -> DataFrame:
    o = cut(views.ratings(s, d), "obs")
    top = ob.sample_ids(o, "itemid", 1).first()
    return ob.common_items(o, top[0] if top else "")


@query("select userid, itemid, round(sum(rating), 6) rating from readable_ratings where userid is not null and itemid is not null group by 1, 2")
def pair_sums(s: SparkSession, d: str) -> DataFrame:
    """Repeated pairs added up, NaN where one of them is."""
    return ob.pair_sums(table(s, d, "readable_ratings")).withColumn("rating", F.round("rating", 6))


@query(f"with {RATINGS_SQL}, pop as (select itemid, count(*)::double prediction from obs group by 1), b as (select min(prediction * prediction) lo, max(prediction * prediction) hi from pop) select itemid, prediction, cast(floor(coalesce((prediction * prediction - lo) / nullif(hi - lo, 0), 0) * 10 + 5) as int) size from pop, b")
def marker_sizes(s: SparkSession, d: str) -> DataFrame:
    pop = ob.history_counts(views.ratings(s, d), "itemid").select("itemid", F.col("n").cast("double").alias("prediction"))
    return ob.marker_sizes(cut(pop, "popularity"), "prediction")


@query(f"with {RATINGS_SQL} select itemid from obs where userid in (select userid from obs group by userid having count(*) >= 30) group by itemid order by {hashed_sql('itemid')}, itemid limit 50")
def sample_rows(s: SparkSession, d: str) -> DataFrame:
    """Fifty items of busy users, drawn by a hash; sampling is the feature."""
    o = cut(views.ratings(s, d), "obs")
    busy = ob.sample_ids(o, "userid", None, min_hist=30)
    return ob.sample_rows(ob.filter_ids(o, "userid", busy).select("itemid").distinct(), 50)


# Co-occurrence

_PAIRS = "pairs as (select a.itemid a, b.itemid b, {value} v from obs a join obs b on a.userid = b.userid and a.itemid <> b.itemid group by 1, 2{having})"
_L1 = "l1 as (select a, b, v / sum(v) over (partition by a) v from pairs), sym as (select a, b, sum(v) v from (select a, b, v from l1 union all select b, a, v from l1) group by 1, 2)"


def _top(src: str, n: int | None, digits: int = 9, name: str = "simil") -> str:
    if n is None:
        return f"{name} as (select a itemid_source, b itemid, round(v, {digits}) prediction from {src})"
    return f"{name} as (select itemid_source, itemid, prediction from (select *, row_number() over (partition by itemid_source order by prediction desc, itemid) k from (select a itemid_source, b itemid, round(v, {digits}) prediction from {src})) where k <= {n})"


def _cooc_sql(n: int | None = 10, value: str = "count(*)", having: str = "", digits: int = 9, source: str = OBS_SQL) -> str:
    return f"with {source}, {_PAIRS.format(value=value, having=having)}, {_L1}, {_top('sym', n, digits)}"


@query(_cooc_sql() + " select * from simil")
def item_cooc_topn(s: SparkSession, d: str) -> DataFrame:
    return co.top_cooccurring(views.obs(s, d), 10)


@query(_cooc_sql(source=RATINGS_SQL) + " select * from simil")
def item_cooc_ratings(s: SparkSession, d: str) -> DataFrame:
    """Over readable_ratings, whose default account holds a tenth of the rows."""
    return co.top_cooccurring(views.ratings(s, d), 10)


@query(_cooc_sql(value="sum(log10(a.rating + 1) * log10(b.rating + 1))", digits=8) + " select * from simil")
def item_cooc_log(s: SparkSession, d: str) -> DataFrame:
    return co.top_cooccurring(views.obs(s, d), 10, digits=8, trans="log")


@query(_cooc_sql(having=" having count(*) >= 3") + " select * from simil")
def item_cooc_min3(s: SparkSession, d: str) -> DataFrame:
    return co.top_cooccurring(views.obs(s, d), 10, min_count=3)


_HIGH = """c as (select greatest(3, quantile_cont(v, 0.5)) c from pairs), h as (select pairs.* from pairs, c where v >= c),
sq as (select x.a, y.b, sum(x.v * y.v) * 0.3::double v from h x join h y on x.b = y.a and x.a <> y.b group by 1, 2),
high as (select a, b, sum(v) v from (select a, b, v::double v from h union all select * from sq) group by 1, 2), f as (select (select sum(v) from pairs) / (coalesce((select sum(v) from high), 0) + 1) f),
both_ as (select a, b, sum(v) v from (select a, b, v::double v from pairs union all select a, b, v * f from high, f) group by 1, 2),
l1 as (select a, b, v / sum(v) over (partition by a) v from both_), sym as (select a, b, sum(v) v from (select a, b, v from l1 union all select b, a, v from l1) group by 1, 2)"""


@query(f"with {OBS_SQL}, {_PAIRS.format(value='count(*)', having='')}, {_HIGH}, {_top('sym', 10, 8)} select * from simil")
def item_cooc_degree2(s: SparkSession, d: str) -> DataFrame:
    """Second degree: pruned at the median and 3, squared with decay 0.3, rescaled, added and normalised."""
    return sc.top_second_degree(views.obs(s, d), 10, 8)


@query(f"""with {OBS_SQL}, pairs as (select a.userid a, b.userid b, count(*) v from obs a join obs b on a.itemid = b.itemid and a.userid <> b.userid group by 1, 2),
l1 as (select a, b, v / sum(v) over (partition by a) v from pairs), {_top("l1", 10)} select itemid_source userid, itemid other, prediction from simil""")
def user_cooc_topn(s: SparkSession, d: str) -> DataFrame:
    return co.top_cooccurring(views.obs(s, d), 10, on="itemid", of="userid", both=False, source="userid", target="other")


# Vectors

_VEC = "v as (select cast(vec_id as varchar) id, embedding::double[] e from embeddings)"


def _vec_sql(expr: str) -> str:
    return f"with {_VEC}, p as (select a.id source, b.id target, round({expr}, 6) prediction from v a join v b on a.id <> b.id) select source, target, prediction from (select *, row_number() over (partition by source order by prediction desc, target) k from p) where k <= 10"


@query(_vec_sql("list_cosine_similarity(a.e, b.e)"))
def vec_cosine_topn(s: SparkSession, d: str) -> DataFrame:
    return si.top_vectors(views.vec(s, d), 10, "cosine", digits=6)


@query(_vec_sql("list_inner_product(a.e, b.e)"))
def vec_dot_topn(s: SparkSession, d: str) -> DataFrame:
    return si.top_vectors(views.vec(s, d), 10, "dot", digits=6)


@query(_vec_sql("1 / (list_distance(a.e, b.e) + 0.001)"))
def vec_euclid_topn(s: SparkSession, d: str) -> DataFrame:
    return si.top_vectors(views.vec(s, d), 10, "euclidean", digits=6)


# Recommendations

_REC = "scores as (select t.userid, s.itemid, round(sum(s.prediction), 9) prediction from {train} t join simil s on s.itemid_source = t.itemid group by 1, 2)"
_CUT = "recs as (select userid, itemid, prediction, k - 1 as rank from (select *, row_number() over (partition by userid order by prediction desc, itemid) k from {src}) where k <= {n})"
_NEW = "fresh as (select * from scores anti join {train} using (userid, itemid))"


_ITEM = f"{_cooc_sql(None)}, {_REC.format(train='obs')}, {_NEW.format(train='obs')}"


@query(f"{_ITEM}, {_CUT.format(src='fresh', n=10)} select userid, itemid, prediction from recs")
def recommend_item_cooc(s: SparkSession, d: str) -> DataFrame:
    return sc.recommend_by_items(cut(views.obs(s, d), "obs"), 10)


@query(f"{_ITEM}, chosen as (select * from fresh where itemid in (select cast(p_partkey as varchar) from part where p_size <= 10)), {_CUT.format(src='chosen', n=10)} select userid, itemid, prediction from recs")
def recommend_item_filter(s: SparkSession, d: str) -> DataFrame:
    return sc.recommend_by_items(cut(views.obs(s, d), "obs"), 10, items=views.items(s, d).filter("p_size <= 10"))


@query(f"""with {OBS_SQL}, pairs as (select a.userid a, b.userid b, count(*) v from obs a join obs b on a.itemid = b.itemid and a.userid <> b.userid group by 1, 2),
l1 as (select a, b, v / sum(v) over (partition by a) v from pairs), {_top("l1", None)},
scores as (select m.itemid_source userid, t.itemid, round(sum(m.prediction * t.rating), 9) prediction from simil m join obs t on t.userid = m.itemid group by 1, 2),
{_NEW.format(train='obs')}, {_CUT.format(src='fresh', n=10)} select userid, itemid, prediction from recs""")
def recommend_user_cooc(s: SparkSession, d: str) -> DataFrame:
    return sc.recommend_by_users(cut(views.obs(s, d), "obs"), 10)


@query(f"{_ITEM}, {_CUT.format(src='fresh', n=10)} select userid, string_agg(itemid, ',' order by rank) items, count(*) n from recs group by userid")
def recommend_lists(s: SparkSession, d: str) -> DataFrame:
    lists = ob.to_lists(recommend_item_cooc(s, d), "userid", "prediction", "itemid", 10)
    return lists.select("userid", F.array_join("itemid", ",").alias("items"), F.size("itemid").cast("bigint").alias("n"))


@query(f"{_ITEM}, one as (select min(userid) u from obs) select u userid, i.itemid, f.prediction from one, (select distinct itemid from obs) i left join fresh f on f.itemid = i.itemid and f.userid = (select u from one)")
def predict_for_user(s: SparkSession, d: str) -> DataFrame:
    o = cut(views.obs(s, d), "obs")
    one = o.agg(F.min("userid").alias("userid"))
    user = one.first()[0]
    return re_.predict_for_user(sc.recommend_by_items(o, None, users=one), user, o.select("itemid").distinct(), o)


@query(f"{_ITEM}, {_CUT.format(src='fresh', n=10)} select userid, itemid, rank from recs")
def rank_zero_based(s: SparkSession, d: str) -> DataFrame:
    return ob.zero_ranks(recommend_item_cooc(s, d), "userid", "prediction", "itemid").select("userid", "itemid", "rank")


# Metrics

_SPLIT = f"""{OBS_SQL.replace("obs as", "obs0 as")}, cut_ as (select *, row_number() over (order by ts desc, userid, itemid) k, count(*) over () n from obs0),
obs as (select userid, itemid, rating from cut_ where k > cast(floor((n - 1) * 0.2) as bigint)), test as (select userid, itemid from cut_ where k <= cast(floor((n - 1) * 0.2) as bigint))"""
_EVAL = f"""with {_SPLIT}, {_PAIRS.format(value="count(*)", having="")}, {_L1}, {_top("sym", None)}, {_REC.format(train="obs")}, {_NEW.format(train="obs")}, {_CUT.format(src="fresh", n="(select least(100, count(distinct itemid)) from obs)")},
h0 as (select t.userid, t.itemid, r.rank from test t left join recs r using (userid, itemid)),
h as (select *, row_number() over (partition by userid order by rank nulls last, itemid) - 1 i, count(rank) over (partition by userid) nh from h0),
ni as (select count(distinct itemid) c from obs),
g as (select userid, count(*) pos, coalesce(avg(case when rank is not null then 1 - greatest(0, rank - i) / nullif(c - nh, 0) end), 0.5) auc, coalesce(max(1.0 / (rank + 1)), 0) reciprocal,
  coalesce(sum(case when rank < 5 then 1.0::double / (rank + 1) end), 0) rrk, coalesce(sum(1.0::double / (rank + 1)), 0) rr, coalesce(sum(case when rank < 5 then 1 / log2(rank + 2) end), 0) dcg, count(*) filter (rank < 5) hit from h, ni group by userid),
m as (select userid, auc, reciprocal, rrk / {{h1}} n_mrr_at_k, rr / {{h2}} n_mrr, dcg / (select sum(1 / log2(j + 2)) from range(0, least(5, pos)) t(j)) n_dcg_at_k, hit / least(5, pos) n_precision_at_k, hit / 5.0::double precision_at_k,
  hit / pos recall_at_k, hit / least(5, pos) n_recall_at_k from g)"""


def _h(x: str) -> str:
    x = f"({x} + 0.001::double)"
    return f"(0.5772156649015329 + ln({x}) + 0.5 / {x} - 1 / (12 * {x} * {x}) + 1 / (120 * {x} * {x} * {x} * {x}))"


_EVAL = _EVAL.replace("{h1}", _h("least(5, pos)")).replace("{h2}", _h("pos"))


def _split(s: SparkSession, d: str) -> DataFrame:
    return ob.split_by_time(views.obs(s, d), "ts", ratio=0.2, ties=_TIES)


def _evaluation(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    parts = _split(s, d)
    train, test = parts.filter("part = 'train'"), parts.filter("part = 'test'").withColumn("dataset", F.lit("test"))
    n_items = train.select("itemid").distinct().count()
    recs = sc.recommend_by_items(train, min(100, n_items), hold=test, top=5)
    return test, cut(recs.select("userid", "itemid", "rank"), "recs"), n_items, train


@query(_EVAL + " select userid, " + ", ".join(f"round({m}, 6) {m}" for m in me.METRICS) + " from m")
def metrics_per_user(s: SparkSession, d: str) -> DataFrame:
    test, recs, n, _ = _evaluation(s, d)
    return me.user_metrics(test, recs, n, 5).select("userid", *[F.round(m, 6).alias(m) for m in me.METRICS])


@query(
    _EVAL
    + ", best as (select count(distinct itemid) b from (select itemid, row_number() over (partition by userid order by itemid) k from test) where k <= 5), got as (select count(distinct itemid) q from h0 where rank < 5) select 'test' dataset, "
    + ", ".join(f"round(avg({m}), 6) {m}" for m in me.METRICS)
    + ", round((select q from got) / (select b from best), 6) n_coverage_at_k from m"
)
def metrics_report(s: SparkSession, d: str) -> DataFrame:
    test, recs, n, _ = _evaluation(s, d)
    return me.report(test, recs, n, 5)


@query(_EVAL + ", c as (select i.itemid, count(r.userid) x from (select distinct itemid from obs) i left join recs r on r.itemid = i.itemid and r.rank < 5 group by 1), o as (select x, row_number() over (order by x) k, count(*) over () n, sum(x) over () t from c) select round(2 * sum(k * x) / (max(n) * max(t)) - (max(n) + 1) / max(n), 6) gini from o")
def gini_coverage(s: SparkSession, d: str) -> DataFrame:
    _, recs, _, train = _evaluation(s, d)
    return me.gini_at_k(recs, train, 5).select(F.round("gini", 6).alias("gini"))


# Features

_PART_COLS = ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")


def _role_sql(c: str) -> str:
    if c in ("p_name", "p_brand", "p_type"):
        return f"(select '{c}' as name, 'cat' as role)"
    n = f"count(distinct {c})"
    return f"(select '{c}' as name, case when {n} = 2 then 'bin' when {n} < 20 or {n} / count(*) <= 0.05 then 'cat' else 'num' end as role from part)"


@query("select * from (" + " union all ".join(map(_role_sql, _PART_COLS)) + ")")
def role_inference(s: SparkSession, d: str) -> DataFrame:
    return fe.roles_table(views.items(s, d).select(*_PART_COLS))


@query("select p_brand as value, row_number() over (order by p_brand) - 1 as code from (select distinct p_brand from part)")
def label_codes(s: SparkSession, d: str) -> DataFrame:
    return fe.encode_labels(views.items(s, d), "p_brand")


@query("select cast(p_partkey as varchar) itemid, unnest(['p_brand=' || p_brand, 'p_type=' || p_type, 'p_size=' || p_size]) feature, 1.0::double weight from part")
def onehot_long(s: SparkSession, d: str) -> DataFrame:
    return fe.one_hot(views.items(s, d), "itemid", ["p_brand", "p_type", "p_size"])


_EDGES = "e as (select [" + ", ".join(f"quantile_cont(p_retailprice, {i / 8})" for i in range(1, 9)) + "] q from part), b as (select cast(p_partkey as varchar) itemid, cast(len(list_filter(q[2:7], lambda x: x < p_retailprice)) as bigint) bin from part, e)"


def _bins(s: SparkSession, d: str) -> DataFrame:
    rows = views.items(s, d)
    return rows.select("itemid", fe.bin_column(F.col("p_retailprice"), fe.quantile_edges(rows, "p_retailprice", 8)).alias("bin"))


@query(f"with {_EDGES} select itemid, bin from b")
def quantile_bins(s: SparkSession, d: str) -> DataFrame:
    return _bins(s, d)


@query(f"with {_EDGES} select itemid, bin, j feature_bin, pow(2.0::double, -abs(j - bin)) weight from b, (select unnest(range(0, 7)) j) where abs(j - bin) <= 2")
def bins_spillage(s: SparkSession, d: str) -> DataFrame:
    return fe.spill(_bins(s, d), 7, 2)


@query(f"with {_EDGES} select itemid, " + ", ".join(f"(xor(bin, bin >> 1) >> {j}) & 1 bit{j}" for j in range(3)) + " from b")
def gray_codes(s: SparkSession, d: str) -> DataFrame:
    bits = fe.gray_bits(F.col("bin"), 7)
    return _bins(s, d).select("itemid", *[b.alias(f"bit{j}") for j, b in enumerate(bits)])


_FEATURES = "f as (select cast(p_partkey as varchar) itemid, unnest(['p_brand=' || p_brand, 'p_type=' || p_type, 'p_size=' || p_size]) feature from part), w as (select *, case when starts_with(feature, 'p_brand') then 2.0 when starts_with(feature, 'p_type') then 0.5 else 1.0 end w from f)"


def _weighted(s: SparkSession, d: str) -> DataFrame:
    return fe.weigh(onehot_long(s, d), {"p_brand": 2.0, "p_type": 0.5})


@query(f"with {_FEATURES} select itemid, feature, round((w / sum(w) over (partition by itemid))::double, 9) weight from w")
def feature_l1_weighted(s: SparkSession, d: str) -> DataFrame:
    return fe.normalise_l1(_weighted(s, d)).select("itemid", "feature", F.round("weight", 9).alias("weight"))


@query(f"""with {_FEATURES}, n as (select itemid, sqrt(sum(w * w)) z from w group by 1), u as (select itemid, feature, w / z x from w join n using (itemid)),
p as (select a.itemid source, b.itemid target, round(sum(a.x * b.x), 6) prediction from u a join u b on a.feature = b.feature and a.itemid <> b.itemid group by 1, 2)
select source, target, prediction from (select *, row_number() over (partition by source order by prediction desc, target) k from p) where k <= 5""")
def feature_cosine_topn(s: SparkSession, d: str) -> DataFrame:
    return si.feature_similarity(_weighted(s, d), 5, 6)


# Ensembles

_MEMBERS = """r as (select distinct recommender, groupby_col g, item_col i, scores_col v from calc_dfs_and_combine_scores
  where scores_col is not null and not isnan(scores_col) and recommender is not null and groupby_col is not null and item_col is not null),
nm as (select count(distinct recommender) nm from r),
k as (select g, i, recommender, rank() over (partition by g, recommender order by v desc) + (count(*) over (partition by g, recommender, v) - 1) / 2.0::double rk from r),
x as (select g, i, list(rk) l, any_value(nm) nm, any_value(nm) - count(*) lack from k, nm group by 1, 2)"""


_FORMS = {
    "hmean": "nm / (list_sum(l) + lack * 50.0::double)",
    "gmean": "exp((-list_sum(list_transform(l, lambda q: ln(q))) - lack * ln(50.0::double)) / nm)",
    "mean": "(list_sum(list_transform(l, lambda q: 1 / q)) + lack / 50.0::double) / nm",
    "min": "least(1 / list_max(l), case when lack > 0 then 1 / 50.0::double end)",
    "max": "greatest(1 / list_min(l), case when lack > 0 then 1 / 50.0::double end)",
}


def _combine(how: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        out = en.combine_members(table(s, d, "calc_dfs_and_combine_scores"), "recommender", "groupby_col", "item_col", "scores_col", 50.0, how)
        return out.select("groupby_col", "item_col", F.round("scores_col", 9).alias("score"))

    return run


for _how, _form in _FORMS.items():
    QUERIES[f"combine_{_how}"] = _combine(_how)
    SQL[f"combine_{_how}"] = f"with {_MEMBERS} select g groupby_col, i item_col, round({_form}, 9) score from x"


@query(f"""{_ITEM}, {_CUT.format(src='fresh', n=10)}, pop as (select itemid, count(*) c from obs group by 1), again as (select userid, itemid, round(c * 1.0::double, 9) prediction from recs join pop using (itemid))
select userid, itemid, prediction from (select *, row_number() over (partition by userid order by prediction desc, itemid) k from again) where k <= 3""")
def cascade(s: SparkSession, d: str) -> DataFrame:
    """Co-occurrence candidates ordered again by popularity."""
    o = cut(views.obs(s, d), "obs")
    first = sc.recommend_by_items(o, 10)
    popular = o.groupBy("itemid").agg(F.count("*").cast("double").alias("prediction"))
    return en.cascade(first, lambda c: c.join(popular, "itemid"), 3)


# Fitted recommenders and ensembles of them

_MIRROR = "{name} as (select itemid_source, itemid, prediction + coalesce(case when low < 0.01 then abs(low - 0.01) end, 0) prediction from (select *, min(prediction) over () low from (select itemid_source, itemid, sum(prediction) prediction from (select * from {src} union all select itemid, itemid_source, prediction from {src}) group by 1, 2)))"


def _ranked(src: str, name: str, by: str = "userid") -> str:
    return f"{name} as (select {by}, itemid, rank() over (partition by {by} order by prediction desc) + (count(*) over (partition by {by}, prediction) - 1) / 2.0::double rk from {src})"


def _voted(parts: list[str], fill: int, by: str = "userid", name: str = "voted") -> str:
    rows = " union all ".join(f"select * from {p}" for p in parts)
    return f"{name} as (select {by}, itemid, {len(parts)} / (sum(rk) + ({len(parts)} - count(*)) * {fill}.0::double) prediction from ({rows}) group by 1, 2)"


def _scored(sim: str, train: str = "obs", name: str = "scores") -> str:
    return f"{name} as (select t.userid, s.itemid, round(sum(s.prediction), 9) prediction from {train} t join {sim} s on s.itemid_source = t.itemid where not exists (select 1 from {train} x where x.userid = t.userid and x.itemid = s.itemid) group by 1, 2)"


def _first(src: str, n: int, name: str, by: str = "userid") -> str:
    return f"{name} as (select {by}, itemid, prediction from (select *, row_number() over (partition by {by} order by prediction desc, itemid) k from {src}) where k <= {n})"


_FINAL = "final as (select userid, itemid, round(prediction, 9) prediction from {src})"


@query(f"{_cooc_sql(10)}, {_MIRROR.format(name='both_', src='simil')}, {_scored('both_')}, {_first('scores', 10, 'recs')} select * from recs")
def similarity_table(s: SparkSession, d: str) -> DataFrame:
    """Recommendations from a given table of similarities, here each item's ten most similar ones, which is the table's size."""
    o = cut(views.obs(s, d), "obs")
    return rc.SimilarityTable().fit_table(o, co.top_cooccurring(o, 10)).recommend(n=10)


@query(f"""{_ITEM}, {_first('fresh', 10, 'one')}, up as (select a.userid a, b.userid b, count(*) v from obs a join obs b on a.itemid = b.itemid and a.userid <> b.userid group by 1, 2),
ul as (select a, b, round(v / sum(v) over (partition by a), 9) v from up), us as (select m.a userid, t.itemid, round(sum(m.v * t.rating), 9) prediction from ul m join obs t on t.userid = m.b where not exists (select 1 from obs x where x.userid = m.a and x.itemid = t.itemid) group by 1, 2),
{_first('us', 10, 'two')}, {_ranked('one', 'r1')}, {_ranked('two', 'r2')}, {_voted(['r1', 'r2'], 11)}, {_FINAL.format(src='voted')}, {_first('final', 10, 'recs')} select * from recs""")
def ensemble_rank(s: SparkSession, d: str) -> DataFrame:
    """Item and user co-occurrence combined by rank."""
    return rc.RankEnsemble([rc.ItemCooccurrence(), rc.UserCooccurrence()]).fit(views.obs(s, d)).recommend(n=10)


@query(f"""{_cooc_sql(20)}, {_FEATURES}, n as (select itemid, sqrt(sum(w * w)) z from w group by 1), un as (select itemid, feature, w / z x from w join n using (itemid)),
fp as (select a.itemid itemid_source, b.itemid itemid, round(sum(a.x * b.x), 9) prediction from un a join un b on a.feature = b.feature and a.itemid <> b.itemid group by 1, 2),
{_first('fp', 20, 'ft', 'itemid_source')}, {_MIRROR.format(name='fm', src='ft')}, fk as (select itemid_source, itemid, round(prediction, 9) prediction from fm where itemid_source in (select itemid from obs)), {_first('fk', 20, 'f20', 'itemid_source')},
{_ranked('simil', 'r1', 'itemid_source')}, {_ranked('f20', 'r2', 'itemid_source')}, {_voted(['r1', 'r2'], 21, 'itemid_source')}, {_MIRROR.format(name='both_', src='voted')}, {_scored('both_')}, {_first('scores', 10, 'recs')} select * from recs""")
def ensemble_similarity(s: SparkSession, d: str) -> DataFrame:
    """Co-occurrence and feature similarities combined by rank into one table, then recommended from; lists of 20, a parameter."""
    o = cut(views.obs(s, d), "obs")
    members = [rc.ItemCooccurrence().fit(o), rc.FeatureSimilarity(n_simil=20).fit_features(o, _weighted(s, d))]
    return rc.SimilarityEnsemble(members, n_unfiltered=20).fit(o).recommend(n=10)


_CELL_GRID = """g as (select distinct itemid, p_retailprice lat, p_size::double long from obs join (select cast(p_partkey as varchar) itemid, p_retailprice, p_size from part) using (itemid)),
qp as (select quantile_cont(lat, [0, 0.5, 1]) q from g), bands as (select i, q[i + 1] lo, q[i + 2] hi from qp, range(2) x(i)),
ql as (select i, lo, hi, quantile_cont(long, [0, 0.5, 1]) q from g join bands on lat between lo and hi group by 1, 2, 3),
grid as (select i * 2 + j cell, round(lo - 0.5, 9) lat_lo, round(hi + 0.5, 9) lat_hi, round(q[j + 1] - 0.5, 9) long_lo, round(q[j + 2] + 0.5, 9) long_hi from ql, range(2) y(j)),
ce as (select itemid, cell from g join grid on lat between lat_lo and lat_hi and long between long_lo and long_hi),
oc as (select cell, userid, itemid from obs join ce using (itemid)),
cp as (select a.cell, a.itemid a, b.itemid b, count(*) v from oc a join oc b on a.cell = b.cell and a.userid = b.userid and a.itemid <> b.itemid group by 1, 2, 3),
cl as (select cell, a, b, v / sum(v) over (partition by cell, a) v from cp), cs as (select cell, a, b, round(sum(v), 9) v from (select * from cl union all select cell, b, a, v from cl) group by 1, 2, 3),
sc as (select t.cell, t.userid, s.b itemid, round(sum(s.v), 9) prediction from oc t join cs s on s.cell = t.cell and s.a = t.itemid where not exists (select 1 from oc x where x.cell = t.cell and x.userid = t.userid and x.itemid = s.b) group by 1, 2, 3),
top as (select * from (select *, row_number() over (partition by cell, userid order by prediction desc, itemid) k from sc) where k <= 10),
rk as (select userid, itemid, rank() over (partition by cell, userid order by prediction desc) + (count(*) over (partition by cell, userid, prediction) - 1) / 2.0::double rk from top),
voted as (select userid, itemid, round(4 / (sum(rk) + (4 - count(*)) * 11.0::double), 9) prediction from rk group by 1, 2)"""


@query(f"with {OBS_SQL}, {_CELL_GRID}, {_first('voted', 10, 'recs')} select * from recs")
def ensemble_cells(s: SparkSession, d: str) -> DataFrame:
    """A co-occurrence model for every cell of a 2 x 2 grid of equal counts over price and size, combined by rank."""
    places = views.items(s, d).select("itemid", F.col("p_retailprice").alias("lat"), F.col("p_size").cast("double").alias("long"))
    return rc.SubdivisionEnsemble(rc.ItemCooccurrence, places, n_lat=2, n_long=2).fit(views.obs(s, d)).recommend(n=10)


@query(
    _EVAL.replace("test as (select userid, itemid from cut_ where k <=", "test as (select userid, itemid from cut_ where userid in (select userid from obs) and itemid in (select itemid from obs) and k <=")
    + ", best as (select count(distinct itemid) b from (select itemid, row_number() over (partition by userid order by itemid) k from test) where k <= 5), got as (select count(distinct itemid) q from h0 where rank < 5) select 'later test' dataset, "
    + ", ".join(f"round(avg({m}), 6) {m}" for m in me.METRICS)
    + ", round((select q from got) / (select b from best), 6) n_coverage_at_k from m"
)
def evaluate_fitted(s: SparkSession, d: str) -> DataFrame:
    """The report of a fitted recommender over held-out data of known users and items."""
    parts = _split(s, d)
    rec = rc.ItemCooccurrence().fit(parts.filter("part = 'train'"))
    return rec.evaluate({"later ": parts.filter("part = 'test'")}, k=5, include_train=False)


@query()
def evaluate_sets(s: SparkSession, d: str) -> DataFrame:
    """Train and two test sets of a ranking factoriser at once, exactly ranked."""
    o = ob.split_by_time(views.obs(s, d), "ts", ratio=0.2, ties=_TIES)
    parts = cut(ob.hash_split(o, 0.5, _TIES, out="half"), "parts")
    rec = rc.RankingRecommender(epochs=3, loss="warp").fit(parts.filter("part = 'train'"))
    return rec.evaluate({h: parts.filter((F.col("part") == "test") & (F.col("half") == h)) for h in ("test", "train")}, n=None)


@query()
def ranking_rows(s: SparkSession, d: str) -> DataFrame:
    """Ten new items per user by pairwise ranking with default parameters."""
    return rc.RankingRecommender().fit(views.obs(s, d)).recommend(n=10)


# Places

_GEO = PLACES_SQL


@query(f"with {_GEO} select * from g where lat between -40 and 10 and long between 100 and 160")
def geo_range(s: SparkSession, d: str) -> DataFrame:
    return views.places(s, d).filter(en.in_box(F.col("lat"), F.col("long"), (-40.0, 10.0, 100.0, 160.0)))


_MIDDLE = "c as (select quantile_cont(lat, 0.5) y, quantile_cont(long, 0.5) x from g)"


def _middle(places: DataFrame) -> tuple[float, float]:
    return (quantiles(places, "lat", [0.5]) or [0.0])[0], (quantiles(places, "long", [0.5]) or [0.0])[0]


@query(f"with {_GEO}, {_MIDDLE} select g.* from g, c where pow(lat - y, 2) + pow(long - x, 2) <= 400")
def geo_circle(s: SparkSession, d: str) -> DataFrame:
    p = cut(views.places(s, d), "places")
    return p.filter(en.in_circle(F.col("lat"), F.col("long"), _middle(p), 400.0))


@query(f"with {_GEO}, {_MIDDLE} select g.* from g, c where lat between y - 15 and y + 15 and long between x - 15 and x + 15")
def geo_square(s: SparkSession, d: str) -> DataFrame:
    p = cut(views.places(s, d), "places")
    return p.filter(en.in_square(F.col("lat"), F.col("long"), _middle(p), 30.0))


@query("select property_id, lat, long from itemsgeomap where lat is not null and long is not null and not isnan(lat) and not isnan(long)")
def clean_places(s: SparkSession, d: str) -> DataFrame:
    return en.clean_places(table(s, d, "itemsgeomap")).select("property_id", "lat", "long")


_SIMPLE = """b as (select min(lat) a, max(lat) b, min(long) c, max(long) d from g), grid as (select i * 4 + j cell, round(a + (b - a) / 3 * i - 0.01, 9) lat_lo, round(a + (b - a) / 3 * (i + 1) + 0.01, 9) lat_hi,
round(c + (d - c) / 4 * j - 0.01, 9) long_lo, round(c + (d - c) / 4 * (j + 1) + 0.01, 9) long_hi from b, range(3) x(i), range(4) y(j))"""
_DENSE = """p as (select quantile_cont(lat, [0, 1/3, 2/3, 1]) q from g), bands as (select i, q[i + 1] lo, q[i + 2] hi from p, range(3) x(i)),
l as (select i, lo, hi, quantile_cont(long, [0, 0.25, 0.5, 0.75, 1]) q from g join bands on lat between lo and hi group by 1, 2, 3),
grid as (select i * 4 + j cell, round(lo - 0.01, 9) lat_lo, round(hi + 0.01, 9) lat_hi, round(q[j + 1] - 0.01, 9) long_lo, round(q[j + 2] + 0.01, 9) long_hi from l, range(4) y(j))"""


@query(f"with {_GEO}, {_SIMPLE} select * from grid")
def geo_grid_simple(s: SparkSession, d: str) -> DataFrame:
    return en.uniform_grid(views.places(s, d), 3, 4, 0.01)


@query(f"with {_GEO}, {_DENSE} select * from grid")
def geo_grid_equidense(s: SparkSession, d: str) -> DataFrame:
    return en.equidense_grid(views.places(s, d), 3, 4, 0.01)


@query(f"with {_GEO}, {_SIMPLE} select itemid, cell from g join grid on lat between lat_lo and lat_hi and long between long_lo and long_hi")
def geo_cells(s: SparkSession, d: str) -> DataFrame:
    places = cut(views.places(s, d), "places")
    return en.assign_cells(places, en.uniform_grid(places, 3, 4, 0.01)).select("itemid", "cell")


# Text, arrays, dimensions


@query("select event_id, cast(json_extract(props, '$.k') as int) k from events")
def json_split(s: SparkSession, d: str) -> DataFrame:
    return fe.split_json(views.events(s, d).select("event_id", "props"), "props", "k int")


@query("select cast(vec_id as varchar) id, unnest(embedding)::double value, unnest(range(1, len(embedding) + 1)) pos from embeddings")
def explode_zip(s: SparkSession, d: str) -> DataFrame:
    rows = views.vec(s, d).select("id", F.col("vec").alias("value"), F.sequence(F.lit(1).cast("bigint"), F.size("vec").cast("bigint")).alias("pos"))
    return ob.from_lists(rows, "value", "pos").withColumn("value", F.col("value").cast("double"))


@query("select user_ind, concat_ws('-', gender, cast(age as varchar), occupation_name, zipcode) made from readable_users")
def concat_key(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "readable_users").select("user_ind", ob.composite_key("gender", "age", "occupation_name", "zipcode").alias("made"))


@query("select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def lookup_join(s: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(s, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("select token, count(*) n from (select unnest(string_split(features_list, '|')) token from itemsgeomap) group by token")
def token_counts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "itemsgeomap").select(F.explode(F.split("features_list", r"\|")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


# Streams, on tables here


@query("select time_bucket(interval 1 day, ts) window_start, time_bucket(interval 1 day, ts) + interval 1 day window_end, event_type itemid, count(*) n, round(sum(value), 4) total from events group by all")
def event_windows(s: SparkSession, d: str) -> DataFrame:
    return ev.windowed(views.events(s, d), "ts", ["itemid"], "1 day").withColumn("total", F.round("total", 4))


@query("""with o as (select user_id, ts, value, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 6 hour or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end f from events),
g as (select *, sum(f) over (partition by user_id order by ts) k from o) select min(ts) window_start, max(ts) + interval 6 hour window_end, cast(user_id as varchar) userid, count(*) n, round(sum(value), 4) total from g group by user_id, k""")
def event_sessions(s: SparkSession, d: str) -> DataFrame:
    return ev.sessions(views.events(s, d), "ts", ["userid"], "6 hours").withColumn("total", F.round("total", 4))


# Trained models, rows only


@query()
def als_rows(s: SparkSession, d: str) -> DataFrame:
    """Ten new items per user by implicit ALS with default parameters, every user against every item."""
    return rc.AlsRecommender().fit(views.obs(s, d)).recommend(n=10)


@query()
def kmeans_rows(s: SparkSession, d: str) -> DataFrame:
    return mo.geo_clusters(cut(views.places(s, d), "places"), 8)


@query()
def cluster_candidates_rows(s: SparkSession, d: str) -> DataFrame:
    users, items = mo.als_factors(views.obs(s, d))
    members, near = mo.cluster_factors(users, items, 10)
    return mo.cluster_candidates(cut(members, "members"), near, 10, 0.1).groupBy("userid").agg(F.count("*").alias("n"))


@query()
def rf_rows(s: SparkSession, d: str) -> DataFrame:
    o = cut(views.obs(s, d), "obs")
    users, items = mo.als_factors(o)
    pairs = cut(mo.negatives(o), "pairs")
    _, apply = mo.rerank_regressor(pairs, users, items)
    return apply(pairs).select("userid", "itemid", "rating", "prediction")


@query(f"with {OBS_SQL}, u as (select userid, row_number() over (order by userid, itemid) p from obs), i as (select itemid, row_number() over (order by {hashed_sql('userid', 'itemid')}, itemid) p from obs) select userid, itemid, 1.0::double rating from obs union all select userid, itemid, 0.0::double rating from u join i using (p)")
def negatives_rows(s: SparkSession, d: str) -> DataFrame:
    return mo.negatives(views.obs(s, d))


@query(f"with {OBS_SQL}, l as (select userid, list_reverse(list(itemid order by ts desc, itemid desc)[1:200]) items from obs group by userid) select userid, cast(len(items) as int) n, array_to_string(items, ',') items from l")
def sequence_rows(s: SparkSession, d: str) -> DataFrame:
    return mo.sequences(views.obs(s, d)).select("userid", F.size("items").alias("n"), F.array_join("items", ",").alias("items"))
