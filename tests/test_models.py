"""Carried states, path integrals and principal components against loops and whole decompositions."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.functions import attribution, bpe, draws, recurrent
from strandflow.operators import reduction
from strandflow.plans import registry


@pytest.mark.parametrize("blocks,batch", [(1, 1000), (3, 2), (200, 1)])
def test_carried_states_against_a_loop(spark, blocks, batch):
    rng = random.Random(1)
    data = [(k if k % 9 else None, 10 * o + rng.randrange(10), [rng.randrange(9) for _ in range(rng.randrange(5))]) for k in [0, *(x for x in range(40) if x % 9)] for o in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(data, "k long, o int, s array<int>").repartition(7)
    got = {(r.k, r.o): r.value for r in recurrent.run(df, "strandflow.functions.recurrent:rolling", "k", "o", "s", blocks=blocks, batch=batch).collect()}
    want, state = {}, {}
    for k, o, s in sorted(data, key=lambda r: r[1]):
        (state[k],), _ = recurrent.rolling.step([state.get(k, 7)], [s])
        want[k, o] = state[k]
    assert got == want


def test_states_odd_rows(spark):
    name = "strandflow.functions.recurrent:rolling"
    df = spark.createDataFrame([(1, 1, [1]), (1, 1, [2])], "k long, o int, s array<int>")
    with pytest.raises(Exception, match="twice"):
        recurrent.run(df, name, "k", "o", "s").collect()
    assert recurrent.run(df.limit(0), name, "k", "o", "s").count() == 0
    assert recurrent.run(df.limit(1).withColumn("s", F.lit(None).cast("array<int>")), name, "k", "o", "s").first().value == 217


class Cubic:
    def value(self, x):
        return (x**3).sum(1)

    def gradient(self, x):
        return 3 * x**2


cubic = Cubic()


def test_path_integrals(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 7))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, []), (902, [2.0])], "k long, v array<double>")
    got = {r.k: r for r in attribution.attribute(df, "strandflow.functions.attribution:quadratic", "k", "v", tolerance=1e-9).collect()}
    assert all(np.allclose(got[k].attribution, v * v * np.arange(1, 8), atol=1e-10) for k, v in enumerate(x))
    assert got[900].attribution is None and got[901].attribution is None and got[902].attribution == pytest.approx([4.0])
    moved = {r.k: r for r in attribution.attribute(df, "tests.test_models:cubic", "k", "v", steps=3, baseline=0.5).collect()}
    assert all(np.allclose(moved[k].attribution, v**3 - 0.125, atol=1e-9) and abs(moved[k].delta) < 1e-9 for k, v in enumerate(x))
    with pytest.raises(Exception, match="more steps"):
        attribution.attribute(df, "tests.test_models:cubic", "k", "v", steps=1, tolerance=1e-6).collect()


def test_components_against_a_decomposition(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(800, 30)) * 2.0 ** -np.arange(30) @ np.linalg.qr(rng.normal(size=(30, 30)))[0] + 5
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(800, None)], "k long, v array<double>").repartition(5)
    c = reduction.fit(df, "v", 3)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.abs(c.directions @ c.directions.T - vt[:3].T @ vt[:3]).max() < 1e-6
    assert np.allclose(c.variance, s[:3] ** 2 / len(x), rtol=1e-6)
    p = {r.k: r.projection for r in reduction.project(df, "k", "v", c).collect()}
    assert p[800] is None and np.allclose(np.abs([p[k] for k in range(800)]), np.abs((u * s)[:, :3]), atol=1e-5)
    with pytest.raises(ValueError):
        reduction.fit(df.limit(0), "v", 2)
    with pytest.raises(Exception, match="length"):
        reduction.fit(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), "v", 1)


def test_registered_components(spark, data):
    got = {r.vec_id: (r.x, r.y) for r in registry.QUERIES["m18_components"](spark, data).collect()}
    e = {r.vec_id: r.embedding for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    x = np.array([e[k] for k in sorted(e)], np.float64)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = np.abs((u * s)[:, :2])
    assert np.allclose(np.abs([got[k] for k in sorted(e)]), want, atol=2e-2 * s[0] / np.sqrt(len(x)))


def test_many_texts_encoded_at_once(spark):
    """All texts of a batch are merged together; the loop over one text gives the same ids and offsets."""
    import random
    import time

    import pyarrow as pa

    from strandflow.functions.bpe import Bpe

    rng = random.Random(3)
    pairs = [("a", "a"), ("aa", "a"), ("b", "a"), ("aaa", "b"), ("aa", "aa"), ("é", "a")]
    m = Bpe(list("ab"), pairs)
    texts = [None, "", "a", "x", *("".join(rng.choices("abé😀", k=rng.randrange(60))) for _ in range(500)), None]
    for t, e in zip(texts, m.encode_many(pa.array(texts)).to_pylist(), strict=True):
        assert (e["ids"], e["starts"], e["ends"]) == ((None, None, None) if t is None else m.encode(t))
    assert m.in_order() and not Bpe(list("ab"), [("ab", "a"), ("a", "b")]).in_order()
    long = pa.array(["".join(rng.choices("ab", k=256)) for _ in range(2000)] * 10)
    begun = time.time()
    assert len(m.encode_many(long)) == 20_000 and time.time() - begun < 4


def test_dropout_of_many_texts_at_once():
    """Ids and spans are those of the text-by-text encoder, draw by draw, in less than half its time."""
    from strandflow.plans import q_models

    rng = random.Random(4)
    prefixes = [rng.randbytes(n) for n in (*range(130), 262, 5000)]
    row, number = np.array([rng.randrange(len(prefixes)) for _ in range(3000)]), np.array([rng.choice([1, 9, 10, 99, 100, 1234567]) for _ in range(3000)])
    want = [int.from_bytes(hashlib.md5(prefixes[i] + b"%d" % k).digest()[:4]) for i, k in zip(row, number.tolist(), strict=True)]
    assert draws.Draws(prefixes)(row, number).tolist() == want
    deep = bpe.Bpe(list("AB"), [("A", "A"), ("A", "B"), ("AA", "AA"), ("AA", "AB"), ("AB", "AB"), ("AAAA", "AB")])
    for model, letters in ((q_models.model(), "ACGTN"), (q_models.model(), "A"), (deep, "AAAB"), (deep, "ABä")):
        for p in (0.1, 0.6, 1.0):
            texts = ["".join(rng.choices(letters, k=rng.choice([0, 1, 2, 3, 50, 256]))) for _ in range(60)]
            got = model.encode_many(pa.array([*texts, None]), p, "s").to_pylist()
            assert [tuple(g.values()) for g in got[:-1]] == [model.encode(t, p, f"s|{t}") for t in texts]
    texts = ["".join(rng.choices("ACGT", k=256)) for _ in range(1024)]
    model, took = q_models.model(), []
    for run in (lambda: model.encode_many(pa.array(texts), 0.1, "s"), lambda: [model.encode(t, 0.1, f"s|{t}") for t in texts]):
        begun = time.process_time()
        run()
        took.append(time.process_time() - begun)
    assert 2 * took[0] < took[1]
