import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.llm import quality_classifier as Q
from dwell.llm import toxicity as T
from dwell.llm.labelled import remainder, sample

SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(np.argsort(score))
    ones = y == 1
    n1, n0 = ones.sum(), (~ones).sum()
    return (order[ones].sum() - n1 * (n1 - 1) / 2) / (n1 * n0)


@pytest.mark.parametrize(("query", "label", "parts", "rest", "least", "threshold"), [(Q.op1_quality_nbsvm, "quality", 5, 0, 0.99, 0.3), (T.op5_toxicity_subword, "toxic", 3, 1, 0.92, 0.7)])
def test_held_out_accuracy(spark, query, label, parts, rest, least, threshold):
    got = query(spark, SF).toPandas().set_index("doc_id")
    assert len(got) == 10_000 and got.score.between(0, 1).all()
    assert [bool(x) for x in got.held_out] == [zlib.crc32(str(i).encode()) % parts == rest for i in got.index]
    assert (got.predicted == (got.score >= threshold)).all()
    y = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")[label]
    own = got.join(y, how="inner")
    own = own[own.held_out]
    assert auc(own.score.to_numpy(), own[label].to_numpy()) > least


def test_dual_descent_meets_the_primal_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    idx = [np.arange(5)] * 60
    w = Q.dual_coordinate_descent(idx, list(x), y, 5, c=0.5, epochs=500, tolerance=1e-8)

    def primal(w):
        return w @ w / 2 + 0.5 * np.maximum(0, 1 - y * (x @ w)).sum()

    best = primal(w)
    assert all(primal(w + rng.normal(size=5) * s) >= best - 1e-6 for s in (0.3, 0.03, 0.003) for _ in range(50))


def test_ratios_follow_the_classes():
    r = Q.log_count_ratios([np.array([0, 2]), np.array([0]), np.array([1])], np.array([1, 1, 0]), 4)
    assert r[0] > r[2] > r[3] > r[1]


def test_misspellings_share_vectors():
    known, odd, other = (set(T.subwords(w)) for w in ("worthless", "worthles5", "garden"))
    assert len(known & odd) > 8 and len(known & other) <= 1
    ids, counts = T.bag("A bb bb")
    assert len(ids) == len(counts) > 0 and T.bag("") == (b"", b"")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, score string, Y int, predicted string")


def labelled(spark, name):
    bad = "awful dreck" if name == "toxic" else "BUY!! NOW!!"
    good = ["the river ran slowly past the old mill", "she read a long letter by the window"]
    rows = [(i, f"{good[i % 2]} {i} " + (bad if i % 2 else "with care") + " and so on", "x", None, "z") for i in range(60)]
    return docs(spark, rows), spark.createDataFrame([(i, int(i % 2 if name == "toxic" else 1 - i % 2)) for i in range(60)], f"doc_id long, {name} int")


@pytest.mark.parametrize(("m", "name"), [(Q, "quality"), (T, "toxic")])
def test_odd_rows_have_scores(spark, m, name):
    d, y = labelled(spark, name)
    model = m.train(d, y)
    odd = docs(spark, [(None, None, "a", 1, "b"), (1, "", "a", 1, "b"), (1, "", "a", 1, "b"), (2, "  \n", None, None, None), (3, "word " * 50_000, "a", 1, "b")])
    got = m.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert m.score(odd.limit(0), model).count() == 0
    kept = m.keep(odd, model, -1.0 if name == "quality" else 2.0)
    assert kept.columns == odd.columns and kept.count() == 5
    assert m.keep(odd, model, 2.0 if name == "quality" else -1.0).count() == 0


@pytest.mark.parametrize(("m", "name"), [(Q, "quality"), (T, "toxic")])
def test_no_labels_or_one_label(spark, m, name):
    d, y = labelled(spark, name)
    assert {r.score for r in m.score(d, m.train(d, y.limit(0))).collect()} == {0.5}
    ones = m.score(d, m.train(d, y.where(F.col(name) == 1))).collect()
    assert min(r.score for r in ones) > 0.9


def test_held_out_ids_and_odd_labels_are_no_training_rows(spark):
    rows = [(i, i % 2) for i in range(40)] + [(None, 1), (50, None), (51, 7), (1, 0)]
    y = spark.createDataFrame(rows, "doc_id long, quality int")
    got = {r.doc_id: r.y for r in sample(y, "quality", Q.held_out, 1000).collect()}
    assert set(got) == {i for i in range(40) if zlib.crc32(str(i).encode()) % 5} and (1 not in got or got[1] == 0)
    assert sample(y, "quality", Q.held_out, 3).count() == 6
    assert spark.range(1).select(remainder(F.lit(None).cast("long"), 5).alias("v")).first().v is None


def plain_grams(text):
    """Buckets of a text's n-grams, one window at a time."""
    import xxhash

    odd, full = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93), 1 << 64

    def shape(w):
        kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w]
        return "".join(c for k, c in enumerate(kinds) if not k or c != kinds[k - 1])

    def code(window, salt):
        x = (salt + len(window)) * odd[3] + sum(c * o for c, o in zip(window, odd, strict=False))
        x %= full
        return (x ^ x >> 29) * odd[1] % full

    words = text.split()
    own = [xxhash.xxh64_intdigest(w.lower(), 1) for w in words]
    shapes = [xxhash.xxh64_intdigest(shape(w), 2) for w in words]
    n = len(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    extra = [1000 + int(10 * same / max(n - 1, 1)), 2000 + min(int(8 * len(set(words)) / max(n, 1) ** 0.8), 16)]
    codes = [*own, *(code(own[i : i + 2], 10) for i in range(n - 1)), *(code(shapes[i : i + k], 20) for k in (1, 2, 3) for i in range(n - k + 1)), *(code([x], 30) for x in extra)]
    return {c >> (64 - Q.BITS) for c in codes}


def test_whole_words_count():
    grams = Q.Grams()
    for a, b in (("x" * 64 + "Q", "x" * 64 + "7"), ("xY" * 100 + "!", "xY" * 100 + "?")):
        assert set(grams(a).tolist()) == plain_grams(a) and set(grams(b).tolist()) == plain_grams(b)
        assert set(plain_grams(a)) != set(plain_grams(b))
        # the shape alone differs too, beyond the word's own bucket
        assert len(plain_grams(a) ^ plain_grams(b)) >= 4


def test_quality_query_agrees_with_a_plain_model(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = sorted((d, y) for d, y in known.items() if d in texts)
    sets, y = [plain_grams(texts[d]) for d, _ in rows], [v for _, v in rows]
    count = [{}, {}]
    for s, v in zip(sets, y, strict=True):
        for g in s:
            count[v][g] = count[v].get(g, 0) + 1
    total = [Q.BUCKETS + sum(c.values()) for c in count]
    ratio = lambda g: np.log((count[1].get(g, 0) + 1) / total[1]) - np.log((count[0].get(g, 0) + 1) / total[0])
    # the same dual problem, its weights in a dictionary
    x = [{**{g: ratio(g) for g in s}, "bias": 1.0} for s in sets]
    w, a, order = {}, [0.0] * len(x), np.random.default_rng(7)
    for _ in range(30):
        worst = 0.0
        for i in order.permutation(len(x)):
            t = 2 * y[i] - 1
            g = t * sum(w.get(k, 0.0) * v for k, v in x[i].items()) - 1
            pg = min(g, 0.0) if a[i] == 0 else max(g, 0.0) if a[i] == 1 else g
            worst = max(worst, abs(pg))
            if pg:
                new = min(max(a[i] - g / sum(v * v for v in x[i].values()), 0.0), 1.0)
                for k, v in x[i].items():
                    w[k] = w.get(k, 0.0) + (new - a[i]) * t * v
                a[i] = new
        if worst < 1e-3:
            break
    got = {r.doc_id: r.score for r in Q.op1_quality_nbsvm(spark, sf).collect()}
    assert set(got) == set(texts)
    for d, text in texts.items():
        margin = w.get("bias", 0.0) + sum(w.get(g, 0.0) * ratio(g) for g in plain_grams(text))
        assert abs(got[d] - 1 / (1 + np.exp(-6 * margin))) < 1e-3


@pytest.mark.parametrize(("m", "name"), [(Q, "quality"), (T, "toxic")])
def test_rows_that_repeat_an_id_are_one_training_row(spark, m, name):
    d, y = labelled(spark, name)
    many = d.unionByName(d.where("doc_id < 20").crossJoin(spark.range(50)).drop("id"))
    extract = (lambda: lambda t: (Q.Grams()(t).tobytes(), b"")) if m is Q else lambda: T.bag
    from dwell.llm.labelled import features

    chosen = sample(y, name, m.held_out, 1000)
    whole = features(d, chosen, extract)
    assert features(many, chosen, extract) == whole
    few = features(d, chosen, extract, most_bytes=1500)
    assert 2 <= len(few) < len(whole) and {r[0] for r in few} == {0, 1} and all(r in whole for r in few)
    assert sum(len(r[1]) + len(r[2]) for r in few) <= 1500 or len(few) == 2


def test_gradients_follow_the_loss():
    rng = np.random.default_rng(5)
    e, w, b = rng.normal(size=(T.BUCKETS, 3)), rng.normal(size=(3, 2)), rng.normal(size=2)
    bags = [T.bag(t) for t in ("one two three", "two two four", "five")]
    bags = [(np.frombuffer(i, np.uint32), np.frombuffer(n, np.float32).astype(float)) for i, n in bags]
    y, weight = np.array([1, 0, 1]), np.array([0.7, 1.9])

    def loss():
        total = 0.0
        for (ids, n), k in zip(bags, y, strict=True):
            z = (e[ids] * n[:, None]).sum(0) / (n.sum() + T.PADDING) @ w + b
            total += weight[k] * (np.log(np.exp(z).sum()) - z[k]) / len(y)
        return total

    def slope(of, at, step=1e-5):
        keep = of[at]
        of[at] = keep + step
        up = loss()
        of[at] = keep - step
        down = loss()
        of[at] = keep
        return (up - down) / (2 * step)

    touched, ge, gw, gb = T.gradients(e, w, b, bags, y, weight)
    assert len(touched) == len(set(touched.tolist())) == len(ge)
    for k in range(0, len(touched), 5):
        assert ge[k] == pytest.approx([slope(e, (touched[k], d)) for d in range(3)], abs=1e-8)
    assert gw.ravel() == pytest.approx([slope(w, (i, j)) for i in range(3) for j in range(2)], abs=1e-8)
    assert gb == pytest.approx([slope(b, j) for j in range(2)], abs=1e-8)


def test_long_words_keep_their_own_vector():
    a, b = "x" * 200 + "yz" + "x" * 200, "x" * 201 + "yz" + "x" * 199
    assert set(T.subwords(a)) != set(T.subwords(b))  # the same n-grams in the same numbers
    assert len(T.subwords("w" * 100_000)) == 2 * 100_002 - 5 + 1


def test_toxicity_query_agrees_with_a_plain_scorer(spark):
    sf = "/root/testdata/sf0.001"
    documents, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = T.train(documents, labels)
    got = {r.doc_id: r.score for r in T.op5_toxicity_subword(spark, sf).collect()}
    for r in documents.collect():
        ids = [x for w in set((r.text or "").lower().split()) for x in T.subwords(w)]
        z = model.bias + sum(float(model.values[i]) for i in ids) / (len(ids) + T.PADDING)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-6
