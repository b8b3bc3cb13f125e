"""Training-data operators: oracle SQL, brute force, held-out accuracy and border cases on small tables."""

import itertools
import math
import re
import zlib

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spatialframe.functions.durable import Scratch
from spatialframe.llm import chat, decontaminate, embedding, langid, minhash, mixing, phrases, quality, queries, toxicity, urls
from spatialframe.llm.words import map_texts

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, __k string, size string, root string"


def words(rng, n, size=400):
    return " ".join("".join("abcdefghij"[int(d)] for d in str(x)) for x in rng.integers(0, size, n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, very long and repeated texts, ties, and columns with clashing names."""
    r = np.random.default_rng(3)
    long, base = words(r, 60_000, 5000).translate(str.maketrans("abcdefghij", "klmnopqrst")), words(r, 120)
    rows = [(None, base, "en", "a"), (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "fr", None), (4, base, "en", "b"), (4, base, "en", "b"), (5, base, "en", "b"),
            (6, base + " more", "en", "b"), (7, long, "fr", "c"), (8, long, "fr", "c"), (9, "?! 12", None, "c"), (10, "one two", "en", "c"), (11, "one two", "en", None)]
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), "x", "y", "z") for i, t, l, s in rows], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    status, _, note = oracle.compare(spark, oracle.duck(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert status == "ok", note


def test_quality_border_cases(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 1), (9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    net = quality.fit_quality(odd, labels)
    got = quality.score_quality(odd, net).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[1] == by[2] == net.prior and by[4] == by[5] and by[7] == by[8]
    kept = quality.filter_quality(odd, net, 0.0)
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert quality.score_quality(none, quality.fit_quality(none, labels.limit(0))).count() == 0


def test_chunks_cover_whole_text():
    net, data = quality.Network(), np.random.default_rng(1).integers(32, 120, 5001).astype(np.uint8).tobytes()
    tables, pairs = quality.pair_tables(net.emb, net.filters), quality.pairs_of(data)
    raw = pairs.view(np.uint8)
    act = np.stack([np.einsum("wd,wdf->f", net.emb[raw[2 * p:2 * p + quality.WIDTH]], net.filters) for p in range(len(pairs) - quality.PAIRS + 1)])
    want = np.stack([act[i:i + quality.POSITIONS].max(axis=0) for i in range(0, len(act), quality.POSITIONS)])
    assert np.allclose(quality.chunk_maxima(pairs, tables), want, atol=1e-4)


@pytest.mark.parametrize("name,label,least", [("op1_quality", "quality", 0.93), ("op10_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (rows["predicted"] == rows[label]).mean() >= least


def test_language(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op9_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() >= 0.97
    assert set(held["held_out"]) == {True} and all(zlib.crc32(str(i).encode()) % 3 == 1 for i in held["doc_id"])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict_language(odd, langid.fit_dictionaries(odd), 0.0).collect()}
    assert all(got[i] == "und" for i in (1, 2, 3, 9)) and got[7] == "fr" and got[4] == "en"
    assert langid.fit_dictionaries(none) == {} and langid.predict_language(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert langid.predict_language(odd, langid.fit_dictionaries(odd), 1.1).where("lang_pred <> 'und'").count() == 0     # every margin is too narrow


def test_toxicity(spark, odd, none):
    r = np.random.default_rng(5)
    rows = [(i, words(r, 60) + (" vilewort" if i % 5 == 0 else ""), "en", "a", 0, "", "", "") for i in range(400)]
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 300)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x["score"] for x in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    assert all((got[i] >= 0.7) == (i % 5 == 0) for i in range(300, 400))
    assert toxicity.score_toxicity(odd, toxicity.fit_toxicity(odd, labels)).where("score between 0 and 1").count() == odd.count()
    assert toxicity.score_toxicity(none, toxicity.fit_toxicity(none, labels)).count() == 0


def test_mixing_targets_and_knapsack(spark, odd, none):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in got)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in got) == sorted(size(r["text"]) for r in odd.collect())
    assert mixing.mix_sources(none).count() == 0
    sizes, weights, targets = [100, 0, 40, 1000, 7], [5, 2, 1, 5, 2], {}
    totals = spark.createDataFrame([(s, n) for s, n in zip(["a", "b", "c", "d", None], sizes)], "source string, words long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(totals).collect()}
    free, left = set(range(5)), float(sum(sizes))               # the excess is reshared until none is above
    while True:
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] >= 3 * sizes[i]}
        if not over:
            break
        for i in over:
            targets[i] = 3.0 * sizes[i]
            left -= targets[i]
        free -= over
    targets |= share
    assert all(math.isclose(got[s], targets[i]) for i, s in enumerate(["a", "b", "c", "d", None]))
    r = np.random.default_rng(2)
    for _ in range(50):
        z, c = np.unique(r.integers(1, 40, 5)), None
        c = r.integers(1, 4, len(z))
        budget = int(r.integers(0, (z * c).sum() + 1))
        n = mixing.fit_counts(z, c, budget)
        best = min(abs(budget - sum(a * b for a, b in zip(p, z))) for p in itertools.product(*[range(k + 1) for k in c]))
        assert (n <= c).all() and abs(budget - (n * z).sum()) == best


def test_decontamination(spark, odd, none):
    r = np.random.default_rng(8)
    item = "A train leaves with 12 kg of coal and meets Anna after 7 hours at the mill where Bert waits with 12 boxes"
    other = item.replace("12", "45").replace("Anna", "Carla").replace("Bert", "David").replace("7", "9")
    torn = other.replace("45 boxes", "46 boxes")                 # one slot of the item gets two values
    text = lambda x: words(r, 30) + " " + x + " " + words(r, 30)
    docs = spark.createDataFrame([(1, text(item), "", "", 0, "", "", ""), (2, text(other), "", "", 0, "", "", ""), (3, text(torn), "", "", 0, "", "", ""), (4, text(""), "", "", 0, "", "", ""),
                                  (None, item, "", "", 0, "", "", ""), (6, None, "", "", 0, "", "", ""), (7, "one two three four five", "", "", 0, "", "", "")], DOC)
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two three four five"), (None, "x y")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["exact"]) for x in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, 1, True), (7, 4, True)}
    assert {x["doc_id"] for x in decontaminate.drop_leaks(docs, bench).collect()} == {3, 4, 6}
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(odd, bench.limit(0)).count() == 0


def test_decontamination_finds_all_passages(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    flat = lambda t: " ".join(t.split())
    items = [(x["item_id"], flat(x["text"])) for x in bench.collect()]
    want = {(d["doc_id"], i) for d in docs.collect() for i, t in items if t in flat(d["text"])}
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs, bench).collect()}
    assert want and want == got


def as_docs(spark, texts):
    return spark.createDataFrame([(i, t, "", "", 0, "", "", "") for i, t in texts], DOC)


def test_decontamination_ignores_case(spark):
    item = "A train leaves with 12 kg of coal and meets Anna after 7 hours at the mill where Bert waits with 12 boxes"
    docs = as_docs(spark, [(1, "SO IT GOES " + item.upper() + " AND ON"), (2, "so it goes " + item.lower() + " and on"), (3, "SO IT GOES " + item.upper().replace("COAL", "SALT").replace("MEETS", "SEES").replace("AT", "BY") + " AND ON")])
    got = {(x["doc_id"], x["exact"]) for x in decontaminate.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {(1, True), (2, True)}


def test_decontamination_finds_all_passages_in_any_case(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    flat = lambda t: " ".join(t.split()).lower()
    items = [(x["item_id"], flat(x["text"])) for x in bench.collect()]
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise(F.lower("text")))
    want = {(d["doc_id"], i) for d in docs.collect() for i, t in items if t in flat(d["text"])}
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs, bench).collect()}
    assert want and want == got


def test_decontamination_of_short_and_numeric_items(spark):
    bench = [(1, "What is 17 + 25?"), (2, "Convert 12 kg 5 g to lb and oz please"), (3, "Give a list of all a m s words here"), (4, "Explain why water boils sooner on mountains"), (5, "Why not?")]
    docs = as_docs(spark, [(1, "we ask What is 17 + 25? and go"), (2, "we ask Convert 12 kg 5 g to lb and oz please and go"), (3, "we ask Give a list of all a m s words here and go"), (4, "we ask Explain why water boils sooner on mountains and go"),
                           (5, "we ask Why not? and go"), (6, "we ask What is 18 + 25? and go"), (7, "we ask Convert 13 kg 5 g to lb and oz please and go")])
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(1, 6)}
    # with other values: the first word follows a word, the last window has few literals
    bench = [(1, "Share 12 pears among all of the boys"), (2, "How far does a lorry drive in 3 h 20 min 5 s")]
    docs = as_docs(spark, [(1, "so they said Share 45 pears among all of the boys"), (2, "we know How far does a lorry drive in 4 h 25 min 6 s")])
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 2)}
    slots = decontaminate.Lexicon().template("a bag of 5 g and 3 A. He took 7. A man")[2]
    assert [i for i, s in enumerate(slots) if s] == [3, 4, 6, 7, 10]


def test_decontamination_of_an_edited_copy(spark):
    r = np.random.default_rng(12)
    item = "we count 12 jars " + words(r, 40) + " then 12 jars " + words(r, 20)
    docs = as_docs(spark, [(1, item.replace("then 12", "then 13")), (2, item.replace("count 12", "count 13")), (3, item.replace("count 12", "count 14").replace("then 12", "then 15").replace("jars", "cups").replace(" a", " x").replace(" b", " y"))])
    got = {(x["doc_id"], x["exact"]): x["n_covered"] for x in decontaminate.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(got) == {(1, True), (2, True)} and min(got.values()) >= 40


def test_urls(spark):
    rows = [(1, "http://a.org/x", '<a href="http://b.net/q">'), (2, "HTTP://B.NET/y?u#v", "<A HREF='//c.net'>"), (3, None, None), (4, "no scheme", ""), (5, "http://www.com/de/1", ""), (6, "http://d.net/z", '<a href="http://www.com/">'),
            (7, "http://example.org/en/12", ""), (7, "http://example.org/en/12", ""), (8, "http://org", ""), (None, "x://", None)]
    pages = spark.createDataFrame([(i, u, h, 1) for i, u, h in rows], "page_id long, url string, html string, rule int")
    got = {r["page_id"]: r for r in urls.judge_pages(pages).collect()}
    assert (got[2]["host"], got[2]["path"], got[2]["rule"], got[2]["verdict"]) == ("b.net", "/y", None, "allow")
    assert (got[1]["rule"], got[5]["rule"], got[7]["rule"]) == ("org/", "com/de/", "example.org/en/1") and got[8]["rule"] is None
    assert got[6]["verdict"] == "block" and got[3]["host"] == got[4]["path"] == ""          # d.net links to a blocked host
    assert urls.judge_pages(pages).count() == len(rows) and urls.judge_pages(pages.limit(0)).count() == 0


def test_distrust_travels_over_many_links(spark):
    rows = [(i, f"http://h{i}.net/x", f'<a href="http://h{i + 1}.net/x">') for i in range(15)] + [(15, "http://h15.net/x", '<a href="http://bad.com/de/1">'), (16, "http://bad.com/de/1", ""), (17, "http://good.org/", '<a href="http://h9.net/">'), (18, "http://free.net", "")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, rule int")
    got = {r["page_id"]: r["verdict"] for r in urls.judge_pages(pages).collect()}
    assert all(got[i] == "block" for i in range(9)) and got[18] == "allow"             # h0 is 16 links from the blocked page
    con = oracle.duckdb.connect()
    con.register("pages", pages.toPandas())
    assert {(r[0], r[4]) for r in con.execute(urls.oracle_sql()).fetchall()} == set(got.items())


def test_embeddings_of_one_place_and_a_stray_end(spark):
    rows = [(i, [1.0, i * 1e-12]) for i in range(4200)] + [(5000, [0.0, 1.0]), (5001, [0.0, 1.0 + 1e-9]), (5002, [0.7, -0.7])]
    table = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<double>, label int, unit int")
    got = {g["vec_id"]: (g["n_links"], g["component_id"]) for g in embedding.link_vectors(table, cell=256).collect()}
    assert all(got[i] == (4199, 0) for i in range(4200)) and got[5000] == (1, 5000) and got[5001] == (1, 5000) and got[5002] == (0, 5002)


def test_embeddings_against_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 8))
    x = np.concatenate([x, x[:30] + r.normal(size=(30, 8)) * 0.06, x[:20] * 3, np.repeat(x[:1], 40, axis=0) + r.normal(size=(40, 8)) * 0.08])
    label = [int(i % 2) for i in range(len(x))]
    rows = [(i, [float(c) for c in v], l, 0) for i, (v, l) in enumerate(zip(x, label))]
    rows += [(900, None, 0, 0), (901, [0.0] * 8, 0, 0), (902, [float("nan")] + [1.0] * 7, 0, 0), (903, [None] + [1.0] * 7, 0, 0), (904, rows[0][1], None, 0), (905, [], 0, 0), (906, [1.0, 2.0], 0, 0), (None, rows[0][1], 0, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, unit int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None, :])
    comp = list(range(len(x)))
    for _ in comp:
        comp = [min(comp[j] for j in np.flatnonzero(link[i])) for i in range(len(x))]
    for kw in ({}, {"cell": 12, "piece": 7}):
        got = {g["vec_id"]: g for g in embedding.link_vectors(table, **kw).collect()}
        assert len(got) == len(rows) and all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(900, 907))
        extra = [int(link[0][i]) for i in range(len(x))]           # the row without an id repeats vector 0
        assert all(got[i]["n_links"] == link[i].sum() - 1 + extra[i] for i in range(len(x)))
        assert all(got[i]["component_id"] == comp[i] for i in range(len(x)))
    assert embedding.link_vectors(table.limit(0)).count() == 0


def classes(df):
    return {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df, Scratch(df.sparkSession)).collect()}


def test_near_duplicates(spark, odd, none):
    r = np.random.default_rng(6)
    texts = []
    for _ in range(25):
        base = words(r, 150, 4000).split()
        texts.append(base)
        for k in (1, 2, 3, 5, 8):
            t = list(base)
            for at in r.integers(0, len(t), k):
                t[at] = "new" + str(r.integers(0, 10**9))
            texts.append(t)
    docs = spark.createDataFrame([(i, " ".join(t), "", "", 0, "", "", "") for i, t in enumerate(texts)], DOC)
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    comp = list(range(len(texts)))
    near = [[j for j in range(len(texts)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(texts))]
    for _ in range(10):
        comp = [min(comp[j] for j in near[i]) for i in range(len(texts))]
    assert classes(docs) == dict(enumerate(comp))
    got = classes(odd)
    assert got[5] == got[6] == 4 and got[8] == 7 and got[11] == 10 and (got[1], got[2], got[3]) == (1, 2, 3) and None not in got
    assert sorted(str(x["doc_id"]) for x in minhash.keep_one(odd).collect()) == sorted(["None", "1", "2", "3", "4", "4", "7", "9", "10"])
    assert classes(none) == {} and minhash.keep_one(none).count() == 0


def slow_index(x, y):
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def weighted(counts):
    kinds = sorted(counts)
    return np.array(kinds, np.int64), 1 + np.log(np.array([counts[k] for k in kinds]))


def test_probability_jaccard_is_the_direct_sum():
    r = np.random.default_rng(8)
    for _ in range(60):
        sides = [{int(k): int(n) for k, n in zip(r.integers(0, 30, 20), r.integers(1, 50, 20))} for _ in range(2)]
        (s, x), (t, y) = map(weighted, sides)
        want = slow_index(dict(zip(s.tolist(), x)), dict(zip(t.tolist(), y)))
        assert math.isclose(minhash.probability_jaccard(s, x, t, y), want, rel_tol=1e-12)
        assert math.isclose(minhash.probability_jaccard(s, x / x.sum(), t, 7 * y), want, rel_tol=1e-12)         # scales don't matter
        # the bound of the prefix filter: shares of the weights in common shingles
        a, b = x[np.isin(s, t)].sum() / x.sum(), y[np.isin(t, s)].sum() / y.sum()
        assert want <= 1 / (1 / a + 1 / b - 1) + 1e-12 if a and b else want == 0


def test_repetitions_weigh_in_sketch_and_index_alike():
    from spatialframe.llm.words import mix
    same, wanted, shared = [], [], 0
    for s in range(60):
        line, rest = mix(np.arange(1, 21, dtype=np.uint64) + np.uint64(s << 20)), mix(np.arange(101, 181, dtype=np.uint64) + np.uint64(s << 20))
        often, once = np.concatenate([np.tile(line, 1000), rest]), np.concatenate([line, rest])                # equal shingle sets, other weights
        sketch = minhash.prob_minhash(np.concatenate([often, once]), np.repeat([0, 1], [len(often), len(once)]), 2)
        same.append((sketch[0] == sketch[1]).mean())
        wanted.append(minhash.probability_jaccard(*minhash.weights_of(often), *minhash.weights_of(once)))
        shared += (minhash.band_keys(sketch)[0] == minhash.band_keys(sketch)[1]).any()
    assert abs(np.mean(same) - wanted[0]) < 0.02 and wanted[0] < 0.8                                           # so these are no near-duplicates


def test_near_duplicates_of_weighted_texts(spark):
    """Classes against all pairs where repetitions decide, and with the given similarity exactly met."""
    r = np.random.default_rng(12)
    rows = []
    for g in range(12):
        base, line = words(r, 60, 4000).split(), words(r, 12, 4000).split()
        rows += [base + line * k for k in (1, 2, 5, 30)] + [base[:50] + line * 30, base + line * 29]
    texts = [" ".join(t) for t in rows]
    from collections import Counter
    sets = [weighted(Counter(hash(tuple(t[i:i + 5])) for i in range(len(t) - 4))) for t in rows]
    near = [[j for j in range(len(rows)) if minhash.probability_jaccard(*sets[i], *sets[j]) >= 0.8 - 1e-9] for i in range(len(rows))]
    comp = list(range(len(rows)))
    for _ in range(10):
        comp = [min(comp[j] for j in near[i]) for i in range(len(rows))]
    assert len(set(comp)) < len(rows) and classes(spark.createDataFrame([(i, t, "", "", 0, "", "", "") for i, t in enumerate(texts)], DOC)) == dict(enumerate(comp))


@pytest.mark.parametrize("turn", [1, -1])
def test_an_id_with_several_texts_loses_none(spark, turn):
    r = np.random.default_rng(5)
    a, b, c = (words(r, 40, 4000) for _ in range(3))
    docs = spark.createDataFrame([(i, t, "", "", 0, "", "", "") for i, t in [(1, a), (2, b), (3, a), (3, b), (3, c)][::turn]], DOC)
    found = {(x["doc_id"], x["text_md5"]): (x["class_id"], x["kept"]) for x in minhash.near_duplicates(docs, Scratch(spark)).collect()}
    md5 = lambda t: __import__("hashlib").md5(t.encode()).hexdigest()
    assert found == {(1, md5(a)): (1, True), (2, md5(b)): (2, True), (3, md5(a)): (1, False), (3, md5(b)): (2, False), (3, md5(c)): (3, True)}
    assert {(x["doc_id"], x["text"]) for x in minhash.keep_one(docs).collect()} == {(1, a), (2, b), (3, c)}


def test_only_texts_that_meet_another_are_shuffled(spark, monkeypatch):
    """Two near copies and an exact one among 400 texts that meet none: the join that fetches the texts to compare moves few others."""
    r = np.random.default_rng(9)
    texts = [words(r, 300, 4000) for _ in range(400)]
    texts += [texts[0] + " end", texts[1] + " end", texts[0]]
    moved, real = [], minhash._sets

    def sets(meeting):
        meeting.collect()
        todo = [meeting._jdf.queryExecution().executedPlan()]
        while todo:
            node = todo.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                todo.append(node.executedPlan())
                continue
            if node.nodeName() == "Exchange":
                moved.append(node.metrics().apply("shuffleRecordsWritten").value())
            if node.nodeName().endswith("QueryStage"):
                todo.append(node.plan())
            kids = node.children()
            todo.extend(kids.apply(i) for i in range(kids.size()))
        return real(meeting)
    monkeypatch.setattr(minhash, "_sets", sets)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = classes(spark.createDataFrame([(i, t, "", "", 0, "", "", "") for i, t in enumerate(texts)], DOC))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {i: {400: 0, 401: 1, 402: 0}.get(i, i) for i in range(403)}
    assert moved and max(moved) <= 8, moved


def shuffled_rows(df):
    """The most rows that an exchange of ``df`` writes."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName() == "Exchange":
            most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        kids = node.children()
        todo.extend(kids.apply(i) for i in range(kids.size()))
    return most


def test_only_documents_that_may_go_are_shuffled(spark):
    """The steps that drop near copies and leaks move the documents in question, not all of them; null ids and texts are keys like others."""
    r = np.random.default_rng(12)
    texts = [words(r, 300, 4000) for _ in range(400)]
    item = words(r, 40, 4000)
    rows = [*enumerate(texts), (400, texts[0] + " end"), (401, texts[0]), (402, None), (None, None), (None, texts[1]), (403, item + " " + words(r, 300, 4000)), (None, item)]
    docs = spark.createDataFrame([(i, t, "", "", 0, "", "", "") for i, t in rows], DOC)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one, clean = minhash.keep_one(docs), decontaminate.drop_leaks(docs, bench)
        moved = shuffled_rows(one), shuffled_rows(clean)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert max(moved) <= 20, moved
    ids = lambda df: sorted(str(x["doc_id"]) for x in df.select("doc_id").collect())
    assert ids(one) == sorted(str(i) for i, _ in rows if i not in (400, 401))
    assert ids(clean) == sorted(str(i) for i, t in rows if item not in (t or ""))


def test_batches_of_texts_are_bounded_in_bytes(spark):
    """What lies in memory at once is a few MB of text, whatever the number of rows."""
    docs = spark.range(3000).repartition(1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    read = lambda b: [pa.RecordBatch.from_arrays([pa.array([sum(x.size for x in b.column(0).buffers() if x)])], ["size"])]
    assert max(x["size"] for x in map_texts(docs, read, "size long").collect()) < 8 << 20


def test_signatures_estimate_probability_jaccard():
    a, b = np.arange(1, 301, dtype=np.uint64), np.arange(61, 361, dtype=np.uint64)
    from spatialframe.llm.words import mix
    both = [minhash.prob_minhash(np.concatenate([mix(a + np.uint64(s << 20)), mix(b + np.uint64(s << 20))]), np.repeat([0, 1], 300), 2) for s in range(20)]
    assert abs(np.mean([(s[0] == s[1]).mean() for s in both]) - 240 / 360) < 0.04


def brute_kept(rows):
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    key = lambda i: math.inf if i is None else i
    first = {}
    for i, t in rows:
        w = split(t)
        for s in range(len(w) - 49):
            k = tuple(w[s:s + 50])
            first[k] = min(first.get(k, math.inf), key(i))
    out = []
    for i, t in rows:
        w = split(t)
        gone = {p for s in range(len(w) - 49) if first[tuple(w[s:s + 50])] < key(i) for p in range(s, s + 50)}
        out.append((i, [x for p, x in enumerate(w) if p not in gone]))
    return out


def test_phrases(spark, odd, none):
    r = np.random.default_rng(9)
    passage, rows = words(r, 90), []
    for i in range(40):
        cut = passage.split()[int(r.integers(0, 30)):][:int(r.integers(40, 91))]
        rows.append((int(r.integers(0, 30)), words(r, 70) + " " + " ".join(cut if i % 2 else cut * 2) + "\n" + words(r, 20)))
    rows += [(None, passage), (50, "the same " * 80), (51, "the same " * 60)]
    docs = spark.createDataFrame([(i, t, "", "", len(t), "", "", "") for i, t in rows], DOC)
    for df in (docs, odd):
        want = brute_kept([(x["doc_id"], x["text"]) for x in df.collect()])
        got = phrases.remove_digest(df).collect()
        import hashlib
        assert sorted((str(g["doc_id"]), g["n_words"] - g["n_removed"], g["kept_sha256"]) for g in got) == sorted((str(i), len(w), hashlib.sha256(" ".join(w).encode()).hexdigest()) for i, w in want)
    left = {(x["doc_id"], " ".join((x["text"] or "").split())) for x in phrases.remove_repeats(odd).collect()}
    assert (8, "") not in left and (1, "") in left and len([1 for i, _ in left if i == 7]) == 1
    assert phrases.remove_repeats(odd).columns == odd.columns
    assert phrases.remove_digest(none).count() == 0 and phrases.remove_repeats(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|end|>"), (1, 2, "bob", None), (1, 2, None, "who"), (1, 70, "ann", "late"), (None, 1, "ann", "x"), (2, None, "bob", "y"), (2, None, "bob", "y"), (3, 0, "system", "alone")]
    turns = spark.createDataFrame([(c, t, r, x, "k") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, part string")
    got = {(g["conv_id"], g["block"], g["perspective"]): g for g in chat.rotate(turns).collect()}
    one = got[1, 0, "ann"]
    assert one["chat"] == "<|system|>\nBe kind.<|end|>\n<|assistant|>\nHi < |end|><|end|>\n<|user name=bob|>\n<|end|>\n<|user name=unknown|>\nwho<|end|>\n"
    assert [one["chat"][m["from"]:m["to"]] for m in one["mask"]] == ["Hi < |end|>"]
    assert set(got) == {(1, 0, "ann"), (1, 0, "bob"), (1, 1, "ann"), (1, 1, "bob"), (None, 0, "ann"), (2, None, "bob")} and got[2, None, "bob"]["n_own"] == 2
    assert chat.rotate(turns.limit(0)).count() == 0
    many = spark.createDataFrame([(1, 5, "ann", str(i)) for i in range(30)], "conv_id long, turn long, role string, text string")
    parts = chat.rotate(many, most=8).collect()
    assert len(parts) > 2 and sum(p["n_turns"] for p in parts) == 30


def test_chat_pieces_join_to_the_whole_rendering(spark):
    rows = [(c, t, r, f"text {i % 7}") for c in (1, None) for i, (t, r) in enumerate([(0, "system")] + [(5 + k % 2, ("ann", "bob")[k % 2]) for k in range(60)] + [(None, "bob")] * 12 + [(70, "ann")])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda g: (g["block"] is not None, g["block"] or 0, g["part"])
    whole, pieces = chat.rotate(turns).collect(), chat.rotate(turns, most=8).collect()
    assert max(g["n_turns"] for g in pieces) <= 8 and len(pieces) > len(whole)
    for who in {(g["conv_id"], g["perspective"]) for g in whole}:
        join = lambda table: "".join(g["chat"] for g in sorted((x for x in table if (x["conv_id"], x["perspective"]) == who), key=key))
        assert join(pieces) == join(whole)


def test_chat_of_crowded_blocks_is_that_of_its_sql(spark):
    rows = [(1, i % 64 if i % 7 else None, ["a", "b", "system", None][i % 4], f"text {i * 7919 % 10007}") for i in range(10_000)] + [(2, 0, "a", "x"), (None, 3, "b", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = oracle.duckdb.connect()
    con.register("conversations", turns.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    fn = lambda spark, _: chat.rotate(turns).withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["from"].cast("string"), m["to"].cast("string"))), ","))
    status, _, note = oracle.compare(spark, con, "chat", fn, chat.ORACLE_SQL, SF)
    assert status == "ok", note


def test_pipeline_stages(spark, odd):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = cp.run(spark, SF)
    assert out.columns == docs.columns + ["copy"] and out.where("copy not between 1 and 3").count() == 0
    for name, stage in cp.STAGES:                                     # no stage stumbles over odd rows
        kept = stage(spark, odd, SF)
        assert kept.columns[:len(odd.columns)] == odd.columns and kept.count() >= 1, name
    assert all(stage(spark, odd.limit(0), SF).count() == 0 for _, stage in cp.STAGES)
