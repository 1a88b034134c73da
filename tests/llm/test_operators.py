"""The ten operators against SQL, brute force, round trips and held-out accuracy, and on odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.llm import common, decontaminate, embedding_dedup, fm_index, minhash_dedup, ngram_lm, packing, quality, queries, substring_dedup, toxicity, url_filter, warc

from ..conftest import oracle, rows

ODD = ["a b c d e f g h i j k l m n o p", None, "", "   \n\t", "x", "A B C D E F G H I J K L M N O P", "é" * 9000, "the " * 4000, "x", "a b c d e f g h i j k l m n o p", "q r s t a b c d e f g h i j k l m n o p q"]


def docs(spark, texts, **more):
    """documents of texts, with extra columns whose names clash with the operators' own"""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return df.withColumns({"score": F.lit("own"), "kept": F.lit(1), "n_words": F.lit("x"), "key": F.lit(2), "component_id": F.lit(0), "shard": F.lit(9)} | more)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, data, name):
    assert rows(queries.QUERIES[name](spark, data).toPandas()) == rows(oracle(queries.ORACLES[name], data))


# --- kernels ---


def test_words_do_not_depend_on_batches():
    texts = ["a bb  ccc", "", None, "\x0b\x1cd\x1f e\x0c", "é ü", " a"]
    w = common.split_words(pa.array(texts, pa.string()))
    got = [[bytes(w.data[s:e]).decode() for s, e, r in zip(w.start, w.end, w.row) if r == k] for k in range(len(texts))]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    whole, alone = w.hashes(), common.split_words(pa.array([" a"])).hashes()
    assert whole[-1] == alone[0] == whole[0] and len(set(whole.tolist())) == len({x for r in got for x in r})
    assert len(common.split_words(pa.array(texts, pa.string()).slice(2, 2)).start) == 2


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 20), (5, 5), *((100, k) for k in range(101, 160)), (159, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 7, **{k: 1 for k in range(100, 160)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1 substring dedup ---


def removed(texts):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    out = []
    for i, w in enumerate(words):
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return out


def test_substring_dedup_brute_force(spark):
    r = np.random.default_rng(1)
    texts = ODD + [" ".join(r.choice(list("abc"), r.integers(0, 60))) for _ in range(40)] + ["p " * 5 + "a b c d e f g h i j k l m n o p" + " z" * 20] * 5
    got = sorted(tuple(x) for x in substring_dedup.remove_repeats(docs(spark, texts)).select("doc_id", F.col("n_words"), "n_removed", "kept_sha256").collect())
    assert got == removed(texts)


@pytest.mark.parametrize("heavy", [0, 3])
def test_substring_dedup_with_heavy_anchors(spark, monkeypatch, heavy):
    monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
    r = np.random.default_rng(5)
    texts = [" ".join(r.choice(list("abcdefgh"), r.integers(10, 40))) for _ in range(60)]
    texts += [" ".join([*r.choice(list("xyz"), 12), "p", "q", "r", "s", "t", *r.choice(list("xyz"), 12)]) for _ in range(60)] + texts[:5]
    got = sorted(tuple(x) for x in substring_dedup.remove_repeats(docs(spark, texts)).select("doc_id", F.col("n_words"), "n_removed", "kept_sha256").collect())
    assert got == removed(texts)


def test_contexts_of_a_frequent_run_are_spread(spark, monkeypatch):
    """2,000 different contexts of one run of five words whose hash is the smallest around: no shard has more than a small share of them."""
    r = np.random.default_rng(6)
    for k in range(100_000):
        run = [f"run{k}", "of", "five", "words", "here"]
        w = common.split_words(pa.array([" ".join(run)]))
        if common.ngrams(w.hashes(), 5)[0] < np.uint64(1 << 49):
            break
    other = lambda n: [f"w{i}" for i in r.integers(0, 1 << 40, n)]
    texts = [" ".join([*other(12), *run, *other(12)]) for _ in range(2000)]
    d = docs(spark, texts).repartition(4)
    sizes = {}
    for heavy in (100, 1 << 60):
        monkeypatch.setattr(substring_dedup, "HEAVY", heavy)
        packed = common.staged(substring_dedup.pack_documents(d.select("doc_id", "text")), "chunks")
        told = packed.union(common.staged(substring_dedup.repeated_anchors(packed, 8), "anchors").select("shard", "kind", "run"))
        words = defaultdict(int)
        for row in substring_dedup.segments(told, 16).collect():
            words[row.shard] += int(common.unpack_arrays(bytes(row.run))[3].sum())
        sizes[heavy] = max(words.values()) / sum(words.values())
    assert sizes[1 << 60] > 0.9 and sizes[100] < 0.12
    assert sum(x.n_removed for x in substring_dedup.remove_repeats(d).collect()) == 0


def test_substring_dedup_carries_columns_and_text(spark):
    d = docs(spark, [ODD[0], ODD[10], None]).select("doc_id", "text", "score", "key")
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(d, with_text=True, also=("score", "key")).collect()}
    assert got[0].kept_text == ODD[0] and got[1].kept_text == "q r s t q" and got[2].kept_text is None and got[1].score == "own" and got[1].key == 2
    assert [tuple(s) for s in got[1].spans] == [(4, 20)]


def test_substring_dedup_empty_and_null_ids(spark):
    assert substring_dedup.remove_repeats(docs(spark, []).limit(0)).count() == 0
    d = spark.createDataFrame([(None, ODD[0]), (None, ODD[0]), (3, ODD[0])], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(d).collect()] == [0, 0, 0]


def test_fm_index_finds_windows_and_misses():
    r = np.random.default_rng(0)
    texts = [r.integers(1, 4, r.integers(5, 30)) for _ in range(120)]
    size = np.array([len(t) for t in texts])
    first = np.cumsum(size + 1) - (size + 1)
    symbols = np.zeros(int(size.sum()) + len(texts), np.int64)
    for t, a in zip(texts, first):
        symbols[a : a + len(t)] = t
    owner = np.arange(len(texts))[::-1]
    fm = fm_index.FmIndex(symbols, 4, np.repeat(owner, size + 1), 13)
    known = {}
    for t, o in zip(texts, owner):
        for k in range(len(t) - 12):
            known[tuple(t[k : k + 13])] = min(known.get(tuple(t[k : k + 13]), 999), o)
    patterns = [*texts, *(r.integers(0, 4, 40) for _ in range(100)), np.concatenate([texts[3], texts[4]])]
    n = np.array([len(p) for p in patterns])
    got = fm.match(np.concatenate(patterns), np.cumsum(n) - n, n)
    assert got.tolist() == [known.get(tuple(p[k : k + 13]), fm_index.NOWHERE) for p in patterns for k in range(len(p) - 12)]


# --- 2 and 6 classifiers ---


def accuracy(spark, data, query, label):
    got = query(spark, data).toPandas().merge(spark.read.parquet(f"{data}/labels.parquet").toPandas(), on="doc_id")
    return got, (got.predicted == got[label]).mean()


def test_quality_held_out(spark):
    got, right = accuracy(spark, "/root/testdata/sf0.01", lambda s, d: quality.op2_quality(s, d).where("held_out"), "quality")
    assert len(got) > 50 and right > 0.95 and got.score.between(0, 1).all()


def test_toxicity_held_out(spark):
    got, right = accuracy(spark, "/root/testdata/sf0.01", lambda s, d: toxicity.op6_toxicity(s, d).where("held_out"), "toxic")
    assert len(got) > 50 and right > 0.93 and got.score.between(0, 1).all()


@pytest.mark.parametrize("labelled", [[], [(0, 1, 1)], [(0, 1, 0), (4, 0, 1), (4, 0, 1), (None, 1, 1), (5, None, None)]])
def test_classifiers_on_odd_inputs(spark, labelled):
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    d = docs(spark, ODD)
    for got in (quality.score(d, quality.train(d, labels), ("doc_id",)), toxicity.score(d, toxicity.train(d, labels), ("doc_id",))):
        scores = [r.score for r in got.collect()]
        assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert quality.score(d.limit(0), quality.train(d, labels), ("doc_id",)).count() == 0


def test_quality_brute_force(spark):
    """The ridge weights by their closed form on the same rows, the calibration by the largest lower mean over upper sets."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    m = quality.train(d, labels)
    both = d.join(labels, "doc_id").orderBy("doc_id").select("doc_id", "text", "quality").toPandas()
    x = quality.statistics(pa.array(both.text)).astype(np.float32).astype(float)
    y = both.quality.to_numpy(float)
    fifth = np.array([zlib.crc32(str(i).encode()) % (1 << 31) % 5 for i in both.doc_id])
    fit = fifth < quality.FIT
    assert np.allclose(m.mean, x[fit].mean(0)) and np.allclose(m.scale, np.maximum(x[fit].std(0), 1e-6), rtol=1e-4)
    z = m.features(x[fit])
    w = np.linalg.lstsq(np.vstack([z, np.sqrt(quality.RIDGE * fit.sum()) * np.eye(z.shape[1])]), np.concatenate([y[fit], np.zeros(z.shape[1])]), rcond=None)[0]
    assert np.allclose(m.raw(x), quality.Model(m.mean, m.scale, m.planes, m.phase, w, m.at, m.value).raw(x), atol=1e-5)
    assert np.allclose(np.sort(isotonic(m.raw(x[~fit]), y[~fit])), np.sort(np.repeat(*blocks_of(m, x[~fit], y[~fit]))))


def blocks_of(m, x, y):
    """(value, size) of the blocks that the rows of x fall into"""
    at, value = quality.pool(m.raw(x), y)
    assert np.allclose(at, m.at) and np.allclose(value, m.value)
    want = isotonic(m.raw(x), y)
    return value, [int(np.isclose(want, v).sum()) for v in value]


def isotonic(x, y):
    """max over starts of min over ends of the means between, with equal x as one point"""
    xs = np.unique(x)
    total, n = np.array([y[x == a].sum() for a in xs]), np.array([(x == a).sum() for a in xs])
    s, c = np.concatenate([[0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(n)])
    fit = [max(min((s[e] - s[b]) / (c[e] - c[b]) for e in range(k + 1, len(s))) for b in range(k + 1)) for k in range(len(xs))]
    return np.array(fit)[np.searchsorted(xs, x)]


def test_isotonic_pools_ties():
    at, value = quality.pool(np.array([1.0, 2, 2, 3]), np.array([0.0, 0, 1, 1]))
    assert value.tolist() == [0.0, 0.5, 1.0] and at.tolist() == [1.0, 2.0, 3.0]


def test_toxicity_brute_force(spark):
    """Ratios by counting n-grams in Python, weights by plain gradient steps to the same loss, on a small corpus."""
    r = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    texts, y = [], []
    for k in range(300):
        y.append(int(k % 3 == 0))
        texts.append(" ".join([*r.choice(words, 30), *(["vile", "scum"] if y[-1] else [])]))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    m = toxicity.train(d, labels)
    grams = []
    for t in texts:
        one = pa.array([t])
        grams.append(set(np.concatenate([b[: max(len(t) + 3 - n, 0)] for n, (b, _) in zip(toxicity.LENGTHS, toxicity.gram_buckets(one), strict=True)]).tolist()))
    pos, neg = sum(y), len(y) - sum(y)
    p, n = Counter(g for s, c in zip(grams, y) if c for g in s), Counter(g for s, c in zip(grams, y) if not c for g in s)
    ratio = {g: math.log((p[g] + 1) / (pos + 2)) - math.log((n[g] + 1) / (neg + 2)) for g in {*p, *n}}
    chosen = set(m.buckets.tolist())
    assert all(abs(m.rest[g] - (0 if g in chosen or p[g] + n[g] < toxicity.SUPPORT else ratio[g])) < 1e-5 for g in ratio)
    x = np.zeros((len(texts), len(m.buckets)))
    place = {g: k for k, g in enumerate(m.buckets.tolist())}
    for k, s in enumerate(grams):
        for g in s & chosen:
            x[k, place[g]] = ratio[g]
    dense = toxicity.rest_sums(pa.array(texts), m.rest)
    yy = np.array(y, float)
    theta = np.append(m.weights / np.array([ratio[g] for g in m.buckets.tolist()]), m.slope)
    full = np.column_stack([x, dense])

    def loss(t, b):
        z = full @ t + b
        return np.mean(np.logaddexp(0, z) - yy * z) + toxicity.RIDGE / 2 * t @ t

    gradient = full.T @ (1 / (1 + np.exp(-(full @ theta + m.bias))) - yy) / len(yy) + toxicity.RIDGE * theta
    assert loss(theta, m.bias) < loss(0 * theta, np.log(pos / neg)) / 4 and np.abs(gradient).max() < 0.02
    assert np.allclose(m.scores(pa.array(texts)), 1 / (1 + np.exp(-(m.scale * (full @ theta + m.bias) + m.shift))), atol=1e-6)


def test_isotonic_pools_violators():
    at, value = quality.pool(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert value.tolist() == [0.0, 0.5, 1.0] and at.tolist() == [1.0, 2.5, 4.0]


def test_toxicity_rescaling():
    rng = np.random.default_rng(3)
    z = rng.normal(size=4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(float)
    a, b = toxicity.rescaling(z, y)
    assert abs(a - 2) < 0.3 and abs(b + 1) < 0.3
    assert toxicity.rescaling(z, np.zeros(4000)) == (1.0, 0.0) and toxicity.rescaling(-z, y) == (1.0, 0.0)
    sure = toxicity.rescaling(np.sign(z), (z > 0).astype(float))
    assert np.isfinite(sure).all() and sure[0] > 1


def test_toxicity_recall_on_held_out_documents(spark):
    data = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in common.table(spark, data, "labels").collect()}
    got = [(r.predicted, labels[r.doc_id]) for r in toxicity.op6_toxicity(spark, data).where("held_out").collect() if r.doc_id in labels]
    caught, false = sum(p for p, y in got if y), sum(p for p, y in got if not y)
    assert caught / sum(y for _, y in got) > 0.86 and false / len(got) < 0.01


# --- 3 decontamination ---


def test_decontamination_odd_inputs(spark):
    items = spark.createDataFrame([(1, "A b c"), (2, None), (3, ""), (4, "a b c d e f g h i j k"), (5, "x"), (6, "never seen words"), (7, "a, b! c")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.items, r.contaminated) for r in decontaminate.decontaminate(docs(spark, ODD), items).collect()}
    assert got[0] == (11, ["1", "4", "7"], True) and got[1] == got[2] == got[3] == (0, [], False) and got[4] == (1, ["5"], True) and got[7][2] is False
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs(spark, ODD), items.limit(0)).collect())
    assert decontaminate.decontaminate(docs(spark, ODD).limit(0), items).count() == 0


def test_decontamination_items_and_documents_without_ids(spark):
    items = spark.createDataFrame([(None, "a b c"), (None, "e f g")], "item_id long, text string")
    d = spark.createDataFrame([(None, "a b c"), (1, "x a b c"), (1, "x a b c"), (2, "e f g a b c")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.decontaminate(d, items).collect()), key=repr)
    assert got == sorted([(None, 0, 0, False), (1, 3, 1, True), (1, 3, 1, True), (2, 6, 1, True)], key=repr)


def test_decontamination_joins_large_benchmarks_by_shuffle(spark, data, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    got = decontaminate.op3_decontaminate(spark, data).toPandas()
    assert rows(got) == rows(oracle(decontaminate.ORACLE_SQL, data))


# --- 4 near-dedup ---


def near(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


def test_near_duplicates_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    r = np.random.default_rng(2)
    base = [" ".join(r.choice([f"w{k}" for k in range(50)], 60)) for _ in range(4)]
    texts = list(ODD)
    for b in base:
        for _ in range(25):
            w = b.split()
            for k in r.integers(0, 60, r.integers(0, 4)):
                w[k] = f"v{r.integers(0, 9)}"
            texts.append(" ".join(w))
    got = sorted(tuple(x) for x in minhash_dedup.near_duplicates(docs(spark, texts)).collect())
    assert got == near(texts)


def test_near_duplicates_empty(spark):
    assert minhash_dedup.near_duplicates(docs(spark, []).limit(0)).count() == 0


def test_linked_counts_exactly():
    sets = [np.array(x, np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3, 5], [1, 2, 3], [9])]
    a, b = minhash_dedup.linked(sets, np.array([0, 1, 2, 3]), np.arange(4), np.arange(4))
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 2), (1, 2), (2, 0), (2, 1)]


# --- 5 url filter ---


def test_urls(spark, monkeypatch):
    urls = ["http://Example.COM/en/7?x#y", "https://a.example.com/en/1", "http://notcom/en/1", "no scheme", None, "http://", "ftp://x.net/de/8", "http://b.example.net/de/80/", "http://x.org", "http://x.org?/es/", "http://É.Com/en/"]
    p = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "n": F.lit(3)})
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.filter_urls(p, url_filter.RULES).collect()}
    assert got[0] == ("example.com", "/en/7", "example.com/en/7") and got[1][2] == "com/en/" and got[2][2] is None and got[3] == got[4] == ("", "", None)
    assert got[6][2] == "net/de/" and got[7][2] == "example.net/de/8" and got[8] == ("x.org", "", None) and got[9] == ("x.org", "", None) and got[10][0] == "É.com"
    many = (*url_filter.RULES, *(url_filter.Rule("allow", f"h{k}.zz", "/") for k in range(300)))
    assert {r.page_id: (r.host, r.path, r.rule) for r in url_filter.filter_urls(p, many).collect()} == got
    assert url_filter.filter_urls(p.limit(0), url_filter.RULES).count() == 0


def test_url_templates_learn_from_labels(spark):
    pages = [(k, f"http://shop.example/{'spam' if k % 2 else 'item'}/{k}") for k in range(200)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(None, 1), (3, None)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(p, labels=labels).collect()}
    assert all(v == ("block" if k % 2 else "allow") for k, v in got.items()) and len(got) == 200


def test_url_templates_reach_the_deepest_segment(spark):
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    pages = [(k, f"http://deep.example/a/b/c/d/{'spam' if k % 2 else 'item'}/{word(k)}") for k in range(200)]
    p = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(p, labels=labels).collect()}
    assert all(v == ("block" if k % 2 else "allow") for k, v in got.items()) and len(got) == 200


def plain_tree(shapes):
    """Node and purity of each (host, masked) -> (n, bad), level by level over dictionaries."""
    u, out = url_filter, {}
    pure = lambda bad, n, above: (bad + u.WEIGHT * above) / (n + u.WEIGHT)

    def grow(node, above, rows):
        for key, left, n, bad in [r for r in rows if not r[1]]:
            out[key] = (node, above)
        kids = defaultdict(list)
        for key, left, n, bad in rows:
            if left:
                kids[left[0]].append((key, left[1:], n, bad))
        count = {s: (sum(r[2] for r in v), sum(r[3] for r in v)) for s, v in kids.items()}
        if len(kids) >= u.FANOUT:
            groups = [("*", list(kids))]
        else:
            groups, last = [(s, [s]) for s in kids if count[s][0] < u.LEAST], None
            for s in sorted((s for s in kids if count[s][0] >= u.LEAST), key=lambda s: (count[s][1] / count[s][0], s)):
                n, bad = count[s]
                if last is not None:
                    n0, bad0 = count[last]
                    p = (bad + bad0) / (n + n0)
                    if (bad / n - bad0 / n0) ** 2 <= u.ALIKE**2 * p * (1 - p) * (1 / n + 1 / n0):
                        groups[-1][1].append(s)
                        last = s
                        continue
                groups.append((s, [s]))
                last = s
        for name, members in groups:
            n, bad = (sum(count[s][k] for s in members) for k in (0, 1))
            grow(f"{node}/{name if name == '*' else min(members)}", pure(bad, n, above), [r for s in members for r in kids[s]])

    hosts = defaultdict(list)
    for (host, masked), (n, bad) in shapes.items():
        hosts[host].append(((host, masked), masked[1:].split("/"), n, bad))
    for host, rows in hosts.items():
        grow("", pure(sum(r[3] for r in rows), sum(r[2] for r in rows), u.PRIOR), rows)
    return out


def test_url_tree_against_a_plain_one(spark):
    import random

    rng = random.Random(11)
    given = {}
    for host in ("a.x", "b.x"):
        for _ in range(260):
            path = "/" + "/".join(rng.choice(["", "p", "q", "r", "news", *(f"s{chr(97 + k)}" for k in range(25))][: rng.choice([3, 5, 30])]) for _ in range(rng.randrange(0, 9)))
            n = rng.randrange(0, 9)
            given[host, path] = (n, rng.randrange(0, n + 1))
    df = spark.createDataFrame([(h, p, n, b) for (h, p), (n, b) in given.items()], "host string, path string, n long, bad long")
    got = {(r.host, r.path): (r.template, r.purity) for r in url_filter.templates(df).collect()}
    want = plain_tree(given)
    assert {k: t for k, (t, _) in got.items()} == {k: t for k, (t, _) in want.items()}
    assert all(got[k][1] == pytest.approx(p, abs=1e-12) for k, (_, p) in want.items())


def test_a_url_of_five_thousand_segments(spark):
    import time

    deep = "http://h.com/en" + "/x" * 5000
    pages = spark.createDataFrame([(1, deep), (2, deep + "/y"), (3, "http://h.com/en/x"), (4, "http://g.org/z" + "/1/a" * 2500), (5, None)], "page_id long, url string")
    began = time.perf_counter()
    got = {r.page_id: r for r in url_filter.filter_urls(pages, url_filter.RULES).collect()}
    assert time.perf_counter() - began < 60
    assert got[1].template == "/en" + "/x" * 5000 and got[2].template == "/en" + "/x" * 5000 + "/y" and got[4].template == "/z" + "/*/a" * 2500
    assert [got[k].verdict for k in (1, 3, 4, 5)] == ["block", "block", "allow", "allow"]


# --- 7 packing ---


def test_packing_brute_force(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    texts = ODD + ["don't it's 'S <|endoftext|> a", "日本語 123 4567 á ÅΣ", "word " * 9000]
    got = packing.pack(packing.cut_pieces(docs(spark, texts), packing.default_tokenizer())).collect()
    want = {}
    for i, x in enumerate(texts):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096


def test_packing_query(spark, data):
    """The registered query: every token of every document once, gapless, in as many sequences as best-fit decreasing takes."""
    got = packing.op7_packing(spark, data).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in got} == ids
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for x in filled.values():
        x.sort()
        assert all(a == sum(n for _, n in x[:k]) for k, (a, _) in enumerate(x)) and x[-1][0] + x[-1][1] <= packing.CAPACITY
    gaps = []
    for n in sorted((r.length for r in got), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else packing.CAPACITY) - n)
    assert len(filled) == len(gaps)


def test_a_very_long_text(spark):
    """30 MB in one row and one word of 3 MB go through the text operators."""
    long = " ".join(f"w{k % 9973} v{k % 101}" for k in range(2_600_000)) + " " + "é" * 1_500_000
    d = spark.createDataFrame([(1, long), (2, "x y " + long[:400]), (3, None)], "doc_id long, text string")
    n = len(long.split())
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(d).collect()}
    assert got[1].n_words == n and got[1].n_removed == 0 and got[2].n_removed > 0
    assert {r.doc_id: r.n_tokens for r in ngram_lm.score(d, ngram_lm.train(d)).collect()} == {1: n + 1, 2: len(("x y " + long[:400]).split()) + 1, 3: 1}
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(d).collect()} == {1: 1, 2: 2, 3: 3}


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        g = min(fit) if fit else capacity
        if fit:
            gaps.remove(g)
        gaps.append(g - n)
    return len(gaps)


@pytest.mark.parametrize("rows", [16, 1 << 17])
def test_sweeps_against_best_fit_decreasing(spark, rows):
    """Random lengths, one length for a third of all, many ranges a sweep: gapless sequences, at most one in fifty more than best-fit decreasing takes."""
    import random

    r = random.Random(rows)
    lengths = [r.randint(1, 40) for _ in range(120)] + [7] * 80 + [40] * 5 + [1] * 30
    got = packing.pack(spark.createDataFrame([(k, 0, n, n) for k, n in enumerate(lengths)], "doc_id long, piece int, length long, _id long"), 40, rows=rows).collect()
    assert sorted((x.doc_id, x.length, x["_id"]) for x in got) == [(k, n, n) for k, n in enumerate(lengths)]
    filled = defaultdict(list)
    for x in got:
        filled[x.sequence_id].append((x.offset, x.length))
    for x in filled.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= 40
    assert len(filled) <= 1.02 * best_fit_decreasing(lengths, 40)


def test_successors_by_stack():
    """Pairs and levels of a stretch against a stack that is swept row by row; levels join stretches as one sweep would."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        kind = rng.integers(0, 2, rng.integers(1, 60))
        stack, want = [], set()
        for i, k in enumerate(kind):
            if k == 0:
                stack.append(i)
            elif stack:
                want.add((stack.pop(), i))
        gap, piece, level = packing.pair_up(kind)
        assert set(zip(gap.tolist(), piece.tolist())) == want
        cut = len(kind) // 2
        before = int((kind[:cut] == 0).sum() - (kind[:cut] == 1).sum())
        parts = np.concatenate([packing.pair_up(kind[:cut])[2], packing.pair_up(kind[cut:])[2] + before])
        assert (parts == level).all()


def test_packing_rejects_bad_lengths(spark):
    with pytest.raises(Exception, match="length"):
        packing.pack(spark.createDataFrame([(1, 0, 5000)], "doc_id long, piece int, length long")).collect()
    assert packing.pack(spark.createDataFrame([], "doc_id long, piece int, length long")).count() == 0


# --- 8 WARC ---


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 90 + "</p>"
    pages = [(5, "http://a/\r\nX: y", big), (3, None, big), (9, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 30), (3, None, big), *((100 + k, "u", f"<html>{k} {'body ' * 80}</html>") for k in range(60))]
    p = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "key": F.lit(1), "first": F.lit(2)})
    back = warc.read_archives(warc.write_archives(p, f"file://{tmp_path}/w")).collect()
    assert len(back) == len(pages)
    got = {r.record_id: r for r in back}
    assert got["5"].record_type == "revisit" and got["5"].refers_to == "3" and got["3"].record_type == "response" and got["9"].record_type == "response"
    assert got["5"].payload_bytes == len(big.encode()) and got["7"].payload_bytes == 0 and got["7"].payload_digest == hashlib.sha256(b"").hexdigest()
    assert all(r.payload == (dict((k, h) for k, _, h in pages)[int(r.record_id)] or "").encode() for r in back if r.record_type == "response")
    assert warc.read_archives(warc.write_archives(p.limit(0), f"file://{tmp_path}/e")).count() == 0


@pytest.mark.parametrize("number", [1, 3, 200])
def test_every_archive_has_a_leading_dictionary(spark, tmp_path, number):
    pages = spark.createDataFrame([(k, "u", f"<html><body>{k} same words in each page {k * 7}</body></html>" * 5) for k in range(number)], "page_id long, url string, html string").coalesce(1)
    found = warc.write_archives(pages, f"file://{tmp_path}/w").collect()
    assert [r.records for r in found] == [number]
    raw = open(found[0].path.removeprefix("file://"), "rb").read()
    size = int.from_bytes(raw[4:8], "little")
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little") and size > 0
    d = warc.zstandard.ZstdDecompressor(dict_data=warc.zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    first = d.decompressobj().decompress(raw[8 + size :])
    assert first.startswith(b"WARC/1.1")
    assert warc.read_archives(spark.createDataFrame(found)).count() == number


def test_archives_split_and_stream(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HELD_BYTES", 4000)
    pages = spark.createDataFrame([(k, "u", f"{k} " + "x" * (k * 13 % 900)) for k in range(150)], "page_id long, url string, html string").coalesce(1)
    found = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=20_000)
    assert found.count() > 3 and {r.record_id for r in warc.read_archives(found).collect()} == {str(k) for k in range(150)}


# --- 9 embeddings ---


def test_embeddings_odd_inputs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 3)
    nan, inf = float("nan"), float("inf")
    vs = [[1.0, 0.0], [2.0, 0.001], [0.0, 0.0], None, [nan, 1.0], [inf, 1.0], [1.0, None], [1.0, 0.0], [1.0, 0.0, 0.0], [-1.0, 0.0], [1e-30, 0.0], *([1.0, 0.01 * k] for k in range(12))]
    df = spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<float>").withColumns({"rep": F.lit(0), "n_links": F.lit("x")})
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link_vectors(df).collect()}

    def fine(v):
        return v is not None and None not in v and all(map(math.isfinite, v)) and any(v)

    def cos(a, b):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        a, b = a / abs(a).max(), b / abs(b).max()
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    n = [sum(i != j and fine(v) and fine(w) and len(v) == len(w) and cos(v, w) >= 0.95 for j, w in enumerate(vs)) for i, v in enumerate(vs)]
    assert [got[i][0] for i in range(len(vs))] == n
    assert all(got[i] == (0, i) for i in (2, 3, 4, 5, 6, 8, 9)) and got[22][1] == 0
    assert embedding_dedup.link_vectors(df.limit(0)).count() == 0


def test_embeddings_recall_at_ten_bits(spark, monkeypatch):
    """All rows against brute force, with the sign bits of a table of 65,536 vectors and more."""
    monkeypatch.setattr(embedding_dedup, "plan_bits", lambda n: 12)
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    r = np.random.default_rng(8)
    base = v.where("vec_id < 600").collect()
    moved = [(1_000_000 + x.vec_id, [float(c) for c in np.array(x.embedding) + r.standard_normal(64) * np.linalg.norm(x.embedding) / 8 * r.uniform(0.0, 0.33)]) for x in base]
    v = v.union(spark.createDataFrame(moved, v.schema))
    got = {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(v).collect()}
    rows_ = [r for r in v.collect() if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    x = np.array([r.embedding for r in rows_], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(1) - 1
    mine = np.array([got[r.vec_id] for r in rows_])
    assert want.sum() > 0 and (mine <= want).all() and mine.sum() >= 0.99 * want.sum()


def test_embeddings_next_to_the_threshold():
    a, b = np.array([0.3, 0.1, 0.7]), np.array([0.2, 0.4, 0.9])
    assert abs(embedding_dedup.exact_cosine(a, b) - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-15


# --- 10 language model ---


def test_language_model_brute_force(spark):
    texts = (["a b c a b", "A b d", "", None, "c c c c", "a b c d e f g", "x y", "b a b a"] * 2 + ["the b the b"] * 300)
    d = docs(spark, texts).withColumn("use", F.col("doc_id") % 7 != 2)
    model = ngram_lm.train(d, keep=F.col("use"), order=2)
    got = {r.doc_id: r for r in ngram_lm.score(d.drop("score"), model).collect()}

    def tokens(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()), "</s>"]

    c = Counter()
    for i, t in enumerate(texts):
        if i % 7 != 2:
            c.update(zip(["<s>", *tokens(t)], tokens(t)))
    cu, n, k, uni = Counter(), defaultdict(lambda: [0] * 4), Counter(), Counter()
    for (u, v), x in c.items():
        cu[u] += x
        n[u][min(x, 3)] += 1
        k[v] += 1
        uni[v] += x
    tally = lambda xs: [sum(x == j for x in xs) for j in (1, 2, 3, 4)]
    d1, e = ngram_lm.discounts(*tally(c.values())), ngram_lm.discounts(*tally(k.values()))
    freed, total, kinds = sum(e[min(x, 3)] for x in k.values()), sum(k.values()), len(k)

    def q(v):
        return (max(k[v] - e[min(k[v], 3)], 0) + freed / (kinds + 1)) / total

    def p(u, v):
        return (max(c[u, v] - d1[min(c[u, v], 3)], 0) + sum(d1[j] * n[u][j] for j in (1, 2, 3)) * q(v)) / cu[u] if cu[u] else q(v)

    for u in ("a", "<s>", "the"):
        assert abs(sum(p(u, v) for v in k) + p(u, "unknown") - 1) < 1e-9
    assert (model.tokens, model.kinds) == (sum(uni.values()), kinds)
    for i, t in enumerate(texts[:20]):
        pairs = list(zip(["<s>", *tokens(t)], tokens(t)))
        assert abs(got[i].score - sum(math.log10(p(u, v)) for u, v in pairs)) < 1e-9
        assert abs(got[i].base_score - sum(math.log10((uni[v] + 1) / (model.tokens + kinds + 1)) for _, v in pairs)) < 1e-9
        assert (got[i].n_tokens, got[i].n_known) == (len(pairs), sum(uni[v] > 0 for _, v in pairs))


def test_language_model_without_text(spark):
    d = docs(spark, ODD).select("doc_id", "text")
    model = ngram_lm.train(d.limit(0))
    assert all(r.score == 0 and r.n_known == 0 for r in ngram_lm.score(d, model).collect())
    assert ngram_lm.score(d.limit(0), model).count() == 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_of_any_order(spark, order):
    texts = ["a b c a b", "A b d a b c", "", None, "c c c c", "a b c d e f g", "x y", "b a b a"] * 2 + ["the b the b"] * 300
    d = docs(spark, texts).withColumn("use", F.col("doc_id") % 7 != 2)
    model = ngram_lm.train(d, keep=F.col("use"), order=order)
    got = {r.doc_id: r for r in ngram_lm.score(d.drop("score"), model).collect()}

    def grams(t):
        w = ["<s>"] * (order - 1) + re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["</s>"]
        return [tuple(w[i : i + order]) for i in range(len(w) - order + 1)]

    levels = {order: Counter(g for i, t in enumerate(texts) if i % 7 != 2 for g in grams(t))}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter()
        for g, x in levels[k + 1].items():
            levels[k][g[1:]] += x if g[1] == "<s>" else 1
    disc = {k: ngram_lm.discounts(*(sum(x == j for x in c.values()) for j in (1, 2, 3, 4))) for k, c in levels.items()}
    total, kinds = sum(levels[1].values()), len(levels[1])
    after = {k: defaultdict(list) for k in levels}
    for k, c in levels.items():
        for g, x in c.items():
            after[k][g[:-1]].append(x)

    def p(g):
        k = len(g)
        below = 1 / (kinds + 1) if k == 1 else p(g[1:])
        xs = after[k][g[:-1]]
        return (max(levels[k][g] - disc[k][min(levels[k][g], 3)], 0) + sum(disc[k][min(x, 3)] for x in xs) * below) / sum(xs) if xs else below

    for u in ("a b c", "<s> <s> <s>", "b the b", "never seen before"):
        u = tuple(u.split())[4 - order :]
        assert abs(sum(p((*u, *v)) for v in levels[1]) + p((*u, "unknown")) - 1) < 1e-9
    assert (model.order, model.kinds) == (order, kinds) and total == model.pairs
    for i, t in enumerate(texts[:20]):
        assert abs(got[i].score - sum(math.log10(p(g)) for g in grams(t))) < 1e-9


def test_registered_language_model_looks_at_two_words_before(spark, data, monkeypatch):
    orders = []
    train = ngram_lm.train
    monkeypatch.setattr(ngram_lm, "train", lambda *a, **b: orders.append(train(*a, **b)) or orders[-1])
    assert ngram_lm.op10_lm_scoring(spark, data).where("score is null or score >= 0").count() == 0
    assert orders[0].order == 3 and sorted(orders[0].d) == [2, 3]


def test_near_duplicates_null_ids_leave_a_class_whole(spark):
    t = " ".join(f"w{k}" for k in range(30))
    d = spark.createDataFrame([(1, t), (None, t), (5, t), (None, None), (5, t)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(d).collect()), key=repr)
    assert got == sorted([(1, 26, 1, True), (5, 26, 1, False), (5, 26, 1, False), (None, 26, None, True), (None, 0, None, True)], key=repr)


def test_words_built_to_collide_do_not():
    """Thue-Morse words and their complements agree under every polynomial hash modulo a power of two."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    h = common.split_words(pa.array([word, other, f"x {word} y", *("a" * k for k in range(1, 40)), "aaaaaaaa\x00"])).hashes()
    assert h[0] != h[1] and h[0] == h[3] and len(set(h.tolist())) == len(h) - 1


def test_language_model_query(spark, data):
    """The registered query's split, counts and base scores, from the texts alone."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for i, t in texts.items()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n = sum(c.values())
    got = {r.doc_id: r for r in ngram_lm.op10_lm_scoring(spark, data).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(tokens[i]), sum(c[w] > 0 for w in tokens[i]), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in tokens[i])) < 1e-6 * len(tokens[i])


def test_language_model_spreads_frequent_words(spark):
    texts = [f"the x{k} the y{k % 7} of the z{k % 3}" for k in range(400)]
    model = ngram_lm.train(docs(spark, texts))
    assert len(model.frequent.hot) and model.hot_stats[:, 0].min() > 0
    assert ngram_lm.score(docs(spark, [None]).select("doc_id", "text", F.lit(None).cast("boolean").alias("held_out")), model, also=("held_out",)).first().n_tokens == 1


def test_url_templates_decide_rows_without_a_rule(spark):
    """On the given pages the templates alone both block and allow, and no rule takes part in those verdicts."""
    from collections import Counter as C

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = url_filter.filter_urls(pages, url_filter.RULES).where("rule is null").collect()
    found = C(r.verdict for r in got)
    assert found["block"] > 0 and found["allow"] > 0
    assert all((r.verdict == "block") == (r.purity > url_filter.PURITY) for r in got)


def test_url_templates_merge_like_branches_and_back_off(spark):
    """Branches a and b share their labels' share and so their subtrees; c differs; a branch without labels takes its parent's purity."""
    rows_, labels, k = [], [], 0
    for branch, bad in (("a", 6), ("b", 7), ("c", 0)):
        for i in range(10):
            for leaf in ("x", "y"):
                rows_.append((k, f"http://h/{branch}/{leaf}/{i}"))
                if leaf == "x" or branch != "b":
                    labels.append((k, int(leaf == "x" and i < bad or branch == "a" and leaf == "y")))
                k += 1
    rows_ += [(k, "http://h/b/y"), (k + 1, "http://h/d/q"), (k + 2, "http://other/z")]
    p = spark.createDataFrame(rows_, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(p, labels=spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    by_url = {u: got[i] for i, u in rows_}
    assert by_url["http://h/a/x/0"].template == by_url["http://h/b/x/0"].template != by_url["http://h/c/x/0"].template
    # no row of b/y is labelled: the verdict comes from a/y, whose subtree it shares
    assert by_url["http://h/b/y/3"].verdict == by_url["http://h/a/y/3"].verdict == "block"
    assert by_url["http://h/c/y/3"].verdict == "allow"
    n, bad = len(labels), sum(b for _, b in labels)
    host = (bad + url_filter.WEIGHT * url_filter.PRIOR) / (n + url_filter.WEIGHT)
    assert abs(by_url["http://h/d/q"].purity - host) < 1e-12 and abs(by_url["http://other/z"].purity - url_filter.PRIOR) < 1e-12
