import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm.borda import borda, borda_top
from quern.llm.clusters import item_groups
from quern.llm.leaks import find_leaks, suffix_array, without_leaks
from quern.llm.neighbours import nearest_vectors, similar_pairs
from quern.llm.packing import pack, pack_texts
from quern.llm.pairs import PairTable
from quern.llm.sentences import sentences
from quern.llm.splits import components, grouped_splits, links, person_keys
from quern.llm.top_items import best_rated, first_ratings


def test_top_items_nulls_ties_repeats(spark):
    kind = "userid string, itemid string, rating double, first_timestamp long, rank string, RANK int"
    rows = [("u", "b", 5.0, 1, "", 1), ("u", "a", 5.0, 1, "", 1), ("u", "a", 5.0, 1, "", 1), ("u", "c", 5.0, None, "", 1), ("u", "d", 4.0, 9, "", 1), ("u", "d", 5.0, 10, "", 1), ("u", "e", None, 1, "", 1), ("u", "f", float("nan"), 1, "", 1), ("", "a", 1.0, 1, "", 1), (None, "a", 1.0, 1, "", 1), ("u", " ", 1.0, 1, "", 1)]
    df = spark.createDataFrame(rows, kind)
    got = [(r.itemid, r.position) for r in best_rated(df, 3).orderBy("position").collect()]
    assert got == [("a", 1), ("b", 2), ("c", 3)]
    assert first_ratings(df).filter("itemid = 'd'").first().rating == 4.0
    assert best_rated(df.limit(0), 3).count() == 0


def test_components_and_splits(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

    rows = [(f"d{i}", f"s{i % 40}" if i % 3 else None, f"e{i // 50}" if i % 50 < 2 else None, i) for i in range(1000)] + [(None, "s1", None, 5)] * 2
    df = spark.createDataFrame(rows, "id string, source string, entity string, split int")
    out = grouped_splits(df, "id", ["source", "entity"], {"train": 0.6, "test": 0.4}, split="part").collect()
    assert len(out) == 1002
    for key in ("source", "entity"):
        seen = {}
        for r in out:
            if r["id"] and r[key]:
                assert seen.setdefault(r[key], r["part"]) == r["part"]


def test_links_have_no_pairs_within_a_group(spark):
    df = spark.createDataFrame([(i, "hot") for i in range(500)], "id long, k string")
    assert links(df, "id", ["k"]).count() == 499


def test_person_notations(spark):
    users = spark.createDataFrame([(3, "bus driver"), (11, "help-desk agent"), (3, None)], "occupation int, occupation_name string")
    same = ["F-35-bus driver-0404400", "35-female-Bus_Driver-404400", " F | 35 | BUS DRIVER | 040 4400", "F-35-3-０４０４４００​"]
    ids = spark.createDataFrame([(x,) for x in [*same, "F-35-help-desk agent-0404400", "rubbish", "", None]], "userid string")
    got = {r.userid: r.person for r in person_keys(ids, users).collect()}
    assert {got[x] for x in same} == {"f|35|3|0404400"} and got["rubbish"] is None and len(got) == 6


def test_pair_table_increments(spark):
    rng = random.Random(1)
    rows = [(f"b{rng.randrange(60)}", f"i{rng.randrange(25)}") for _ in range(700)] + [("big", f"i{k}") for k in range(25)] * 3 + [(None, "i1"), ("b1", ""), ("b1", None)]
    rng.shuffle(rows)
    kind = "basket string, item string"

    def brute(data):
        baskets = {}
        for b, i in data:
            if b and i:
                baskets.setdefault(b, set()).add(i)
        kept = [v for v in baskets.values() if len(v) <= 20]
        c = Counter((a, b) for v in kept for a in v for b in v if a < b)
        return c, Counter(i for v in kept for i in v), len(kept)

    held = PairTable(spark, max_basket=20, buckets=3)
    for s in range(0, len(rows), 300):
        held.apply(spark.createDataFrame(rows[s : s + 300], kind))
        pairs, own, n = brute(rows[: s + 300])
        got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b) for r in held.scores().collect()}
        assert got == {(a, b): (k, own[a], own[b]) for (a, b), k in pairs.items()} and held.n_baskets == n
    held.apply(spark.createDataFrame([], kind))
    assert held.scores().count() == len(pairs)
    assert PairTable(spark).apply(spark.createDataFrame([], kind)).scores().count() == 0


def test_borda(spark):
    kind = "g string, s string, i string, v double, rank int, w int"
    rows = [("g", "s", "a", 9e9), ("g", "s", "b", 1.0), ("g", "s", "b", 1.0), ("g", "t", "b", 0.2), ("g", "t", "c", 0.2), ("g", "t", "a", float("-inf")), ("g", "u", "a", float("nan")), ("g", "t", "z", None), (None, "t", "z", 1.0)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], kind)
    after = {r.i: (r.mean_rank, r.sources) for r in borda(df, "g", "s", "i", "v", missing="after").collect()}
    assert after == {"a": (2.0, 2), "b": (1.75, 2), "c": (2.25, 2)}
    middle = {r.i: r.mean_rank for r in borda(df, "g", "s", "i", "v").collect()}
    assert middle == {"a": 2.0, "b": 1.75, "c": 2.25}
    assert [r.i for r in borda_top(df, "g", "s", "i", "v", 2).orderBy("position").collect()] == ["b", "a"]
    assert borda(df.limit(0), "g", "s", "i", "v").count() == 0
    with pytest.raises(ValueError):
        borda(df, "g", "s", "i", "v", missing="zero")


def _vectors(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x[n // 2 :] = x[: n - n // 2] + rng.normal(size=(n - n // 2, dim)) * 0.05
    rows = [(f"v{i}", [float(v) for v in x[i]]) for i in range(n)]
    return x, spark.createDataFrame([*rows, rows[0], ("copy", rows[3][1]), ("nul", None), ("few", [1.0]), ("zero", [0.0] * dim), ("nan", [float("nan")] * dim), (None, rows[5][1])], "id string, e array<float>")


def test_similar_pairs_and_neighbours(spark):
    x, df = _vectors(spark, 1200, 8, 3)
    ids = [f"v{i}" for i in range(1200)] + ["copy"]
    m = np.vstack([x, x[3:4]]).astype(np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    want = {tuple(sorted((ids[i], ids[j]))) for i, j in np.argwhere(s >= 0.97) if i < j}
    got = {(r.id_a, r.id_b) for r in similar_pairs(df, "id", "e", 0.97, 8).collect()}
    assert got == want
    near = {}
    for r in nearest_vectors(df, "id", "e", k=5, dim=8, every=1).collect():
        near.setdefault(r.id, set()).add(r.neighbour)
    np.fill_diagonal(s, -2)
    hit = sum(len({ids[j] for j in np.argsort(-s[i])[:5]} & near[ids[i]]) for i in range(len(ids)))
    assert hit / (5 * len(ids)) >= 0.9 and "v3" in near["copy"]
    assert similar_pairs(df.limit(0), "id", "e", 0.97, 8).count() == 0


def test_groups(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k, size in enumerate((40, 12, 3)):
        c = rng.normal(size=64)
        rows += [("s", f"{k}-{i}", [float(v) for v in c + rng.normal(size=64) * 0.3]) for i in range(size)]
    rows += [("s", f"x{i}", [float(v) for v in rng.normal(size=64)]) for i in range(6)] + [rows[0], ("s", "nul", None), (None, "y", rows[0][2]), ("other", "z", rows[0][2])]
    df = spark.createDataFrame(rows, "segment string, itemid string, item_embeddings array<float>")
    counts = spark.createDataFrame([("s", 3), ("none", 2)], "segment string, n_clusters int")
    got = Counter(r["first"] for r in item_groups(df, counts).collect())
    assert got == {"0-0": 40, "1-0": 12, "2-0": 3}
    assert item_groups(df.limit(0), counts).count() == 0


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i if i % 9 else None, rng.choice([0, 1, 5, 30, 31, 40, 60, 99, 100, 101, 250]), i) for i in range(2000)] + [(7, None, 1), (8, 40, 8), (8, 40, 8)]
    df = spark.createDataFrame(rows, "id int, tokens long, mark long")
    out = pack(df, 100, tiny=10).collect()
    per = Counter()
    for r in out:
        per[r["window"]] += r["tokens"]
        assert r["pieces"] == 1 or r["first"] % 100 == 0
    assert max(per.values()) <= 100 and sum(per.values()) == sum(r[1] or 0 for r in rows)
    assert sum(per.values()) / (100 * len(per)) > 0.75
    assert pack(df.limit(0), 100).count() == 0
    long = spark.createDataFrame([(1, "word " * 3000, 5), (2, "", 5), (3, None, 5), (4, "x" * 100_000, 5)], "doc_id long, text string, tokens int")
    found = pack_texts(long).filter("pieces > 1").select("id").distinct().collect()
    assert {r.id for r in found} == {1, 4}


def test_suffix_array():
    rng = np.random.default_rng(0)
    u = rng.integers(0, 3, 300).astype(np.int32)
    order = suffix_array(u, 12)
    assert sorted(range(300), key=lambda i: (tuple(u[i : i + 16]), i)) == list(order)


def test_leaks(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = spark.createDataFrame([(1, "en", passage), (2, "ja", "あいうえおかきくけこさしすせそたちつてとなにぬ"), (3, "en", "short"), (4, None, None)], "eval_id long, lang string, text string")
    words = passage.split()
    docs = [(1, "X <b>ONE</b>, two\nthree four *five* six seven eight nine ten: eleven twelve end"), (2, " ".join(words[:11]) + " other " + " ".join(words[11:])), (3, "前。あいうえお、かきくけこ さしすせそ「たちつてと」後"), (4, "あいうえおかきくけこさしすせそたちつて 以上"), (5, None), (6, ""), (7, "filler " * 20_000 + passage), (7, "filler " * 20_000 + passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.eval_id): (r.longest, r.doc_place, r.eval_place) for r in find_leaks(df, items).collect()}
    assert got == {(1, 1): (12, 1, 0), (3, 2): (20, 1, 0), (7, 1): (14, 20_000, 0)}
    assert without_leaks(df, find_leaks(df, items)).count() == 4
    assert find_leaks(df.limit(0), items).count() == 0 and find_leaks(df, items.limit(0)).count() == 0


CASES = [
    ["Dr. Who paid 3.50 dollars.", "It was cheap!", '"Why?" was all my aunt could say.'],
    ['My aunt said, "Never lend it to anyone."', "We left at 10 p.m.", "Nobody saw J. R. Smith of Foo Inc. again."],
    ["(Yes, I did read it.)", "Well... it works, e.g. for cooking, etc., and more.", "It cost me 57.", "See www.shop.example for No. 10."],
    ["Am 26. Mai kam z. B. der zweite Karton an.", "Frau Dr. Vogel meinte: „Nie wieder.“", "Das kostet 5 EUR inkl. MwSt.", "„Gut. Billig.“, sagte er."],
    ["¿La compraría otra vez?", "¡Sí, sin dudarlo!", "«Es mía. Es buena.», dijo la Sra. Gil de EE. UU. riendo."],
    ["Plus jamais !!!", "M. Noir parle de 5,5 kg env. pour la lampe."],
    ["См. стр. 7, рис. 13.", "«Неужели?» — так ответили нам.", "Весит 2 кг, т. е. мало, и т. д. по списку."],
    ["这个三脚架用了7天就坏了。", "（说明书我看过了。）", "等啊等……", "姐姐说：“它好。它便宜。”然后就走了。", "说实话，3.20版才支持……算了吧。"],
    ["「もう無理！」と姉が叫びました。", "うーん…こんなものかな。", "待って…待って…", "二度と買いません！！"],
    ['पड़ोसी ने कहा, "यह हल्का है। सस्ता है।" और चला गया।', "डॉ. राम का वज़न 3.5 कि.ग्रा. है।"],
    ["قال د. أحمد إن الوزن 8.5 كغ.", "هل أشتريه مرة أخرى؟"],
    ["หนัก 22.5 กก. หนักกว่าเดิมครับ", "ราคาไม่แพงค่ะ", "ดีมากครับ"],
    ["it works.", "would i buy it again?", "dr. no said so at 9 a.m. sharp."],
]


def test_sentences(spark):
    texts = [("" if any(ord(c) > 0x3000 for c in "".join(x)) and "（" + "。" and x[0][-1] in "。！？" else " ").join(x) for x in CASES]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sentences(df).orderBy("id", "sentence").collect():
        got.setdefault(r.id, []).append(r.text)
    for i, want in enumerate(CASES):
        assert got[i] == want


def test_sentence_lines_and_edges(spark):
    rows = [(1, "It is good\nI like it a lot\nFive stars"), (2, "This is a hard-wrapped line of a review that goes on and\non until it ends. Then one more."), (3, None), (4, "  \n "), (5, " no mark "), (6, "a " * 50_000 + "end. Next one."), (7, "needed!Yes, it was.No."), (7, "\U0001f600 fine. Ok.")]
    out = sentences(spark.createDataFrame(rows, "doc_id long, text string").withColumn("sentence", F.lit(1))).collect()
    by = {}
    for r in out:
        by.setdefault(r.id, []).append((r.sentence, r.end_pos, r.text))
    assert [t for _, _, t in by[1]] == ["It is good", "I like it a lot", "Five stars"]
    assert len(by[2]) == 2 and 3 not in by and 4 not in by
    assert by[5] == [(1, 8, "no mark")] and len(by[6]) == 2
    assert (1, 7, "\U0001f600 fine.") in by[7] and (2, 19, "Yes, it was.") in by[7]


@pytest.mark.parametrize("chunk,bucket_pairs", [(4, 20), (2048, 2_000_000)])
def test_pair_table_compacts_grows_and_leaves_no_basket_out(spark, monkeypatch, chunk, bucket_pairs):
    from quern.llm import pairs

    monkeypatch.setattr(pairs, "CHUNK", chunk)
    monkeypatch.setattr(pairs, "BUCKET_PAIRS", bucket_pairs)
    monkeypatch.setattr(pairs, "RUNS", 1)
    rng = random.Random(2)
    rows = [(f"b{rng.randrange(12)}", f"i{rng.randrange(15)}") for _ in range(90)] + [("hot", f"i{k}") for k in range(15)]
    rng.shuffle(rows)
    held = PairTable(spark, max_basket=None, min_pair=2)
    for s in range(0, len(rows), 60):
        held.apply(spark.createDataFrame(rows[s : s + 60], "basket string, item string"))
    baskets = {}
    for b, i in rows:
        baskets.setdefault(b, set()).add(i)
    want = Counter((a, b) for v in baskets.values() for a in v for b in v if a < b)
    own = Counter(i for v in baskets.values() for i in v)
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b) for r in held.scores(min_pair=2).collect()}
    assert got == {(a, b): (k, own[a], own[b]) for (a, b), k in want.items() if k >= 2}
    assert len(held.runs) == 1 and held.n_baskets == len(baskets)
    with pytest.raises(ValueError):
        held.scores()


def test_zip_codes_keep_all_their_digits(spark):
    users = spark.createDataFrame([(3, "judge")], "occupation int, occupation_name string")
    ids = spark.createDataFrame([("F-35-judge-12345678",), ("F-35-judge-12345679",), ("F-35-judge-123",)], "userid string")
    assert {r.userid: r.person for r in person_keys(ids, users).collect()} == {"F-35-judge-12345678": "f|35|3|12345678", "F-35-judge-12345679": "f|35|3|12345679", "F-35-judge-123": "f|35|3|0000123"}


def test_an_id_with_several_vectors_is_linked_by_any(spark):
    e = lambda k, sign=1.0: [sign if i == k else 0.01 for i in range(64)]
    rows = [("s", n, e(k)) for k in (0, 9) for n in [f"{k}-{i}" for i in range(3)]] + [("s", "both", e(0)), ("s", "both", e(9)), ("s", "far", e(30))]
    df = spark.createDataFrame(rows, "segment string, itemid string, item_embeddings array<float>")
    counts = spark.createDataFrame([("s", 2)], "segment string, n_clusters int")
    assert Counter(r["first"] for r in item_groups(df, counts).collect()) == {"0-0": 7}


@pytest.mark.parametrize("width", [50, 72, 100])
def test_wrapped_text_without_case_keeps_its_sentences(spark, width):
    import textwrap

    words = "यह थैला बहुत अच्छा है और मैं इसे रोज़ बाज़ार ले जाता हूँ क्योंकि इसमें सारा सामान आ जाता है".split()
    text = textwrap.fill(" ".join(words * 6) + "।", width)
    short = textwrap.fill(" ".join(words * 6)[: int(1.5 * width)].rsplit(" ", 1)[0] + "।", width)
    lines = "यह थैला अच्छा है\nमैं इसे रोज़ बाज़ार ले जाता हूँ और इसमें सारा सामान आ जाता है\nसस्ता है\nइसका रंग भी बहुत अच्छा है"
    got = sentences(spark.createDataFrame([(1, text), (2, lines), (3, short)], "doc_id long, text string")).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {1: 1, 2: 4, 3: 1}


def test_long_quotations_brackets_and_addresses(spark):
    inner = "It is good. " * 60
    texts = [f'He said, "{inner.strip()}" and left. Then he came back.', f"A note ({inner.strip()}) follows here. The end.", "See http://shop.example/" + "a" * 150 + ".b.c/d.e for it. Fine."]
    got = {r["id"]: r["count"] for r in sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).groupBy("id").count().collect()}
    assert got == {0: 2, 1: 2, 2: 2}


def test_tags_of_any_length_are_no_difference(spark):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    items = spark.createDataFrame([(1, "en", " ".join(words))], "eval_id long, lang string, text string")
    tag = '<a href="' + "x" * 5000 + '">'
    docs = spark.createDataFrame([(1, " ".join(words[:6]) + tag + " " + " ".join(words[6:]))], "doc_id long, text string")
    assert [r.longest for r in find_leaks(docs, items).collect()] == [12]


def test_related_texts_and_rendezvous(spark):
    from quern.llm.splits import related_texts

    kind = "doc_id long, userid string, text string"
    rows = [(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", "z"), (5, None, " "), (6, "", None), (7, "d", "x")]
    got = {r.doc_id: (r.component, r.split) for r in related_texts(spark.createDataFrame(rows, kind)).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 1}
    assert len({got[k] for k in (1, 2, 3, 7)}) == 1
    assert related_texts(spark.createDataFrame([], kind)).count() == 0
