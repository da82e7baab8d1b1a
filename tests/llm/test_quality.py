import numpy as np

from conftest import FOLDER
from fleetpulse.llm import quality as op
from fleetpulse.llm.tables import table
from llm.conftest import ODD


def test_logistic_is_at_the_minimum():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(500, 4)), rng.uniform(0.5, 1, 500)
    y = (rng.random(500) < 1 / (1 + np.exp(-x @ [1, -2, 0, 0.5]))).astype(float)
    got = op.logistic(x, y, w, 0.5, 50)

    def loss(v):
        z = x @ v[:-1] + v[-1]
        return (w * (np.logaddexp(0, z) - y * z)).sum() + 0.25 * (v[:-1] ** 2).sum()

    for k in range(5):
        for d in (1e-3, -1e-3):
            assert loss(got + d * np.eye(5)[k]) >= loss(got) - 1e-9


def test_long_words_have_whole_shapes():
    for tail in ("!7B", "漢字。カナ", "%%;" * 3000):
        long, short = "x" * 5000 + tail, "xx" + tail
        assert op._shape_place(long) == op._shape_place(short) != op._shape_place("xx")


def test_each_view_teaches_the_other():
    """One view is labelled by a feature that no labelled row of the other view shows."""
    rng = np.random.default_rng(2)

    def rows(n, novel):
        good = rng.random(n) < 0.5
        a = np.stack([good * 2.0 - 1 + rng.normal(0, 0.3, n), rng.normal(0, 1, n)], axis=1)
        b = np.stack([(good * 2.0 - 1) * (0 if novel else 1), (good * 2.0 - 1) * novel], axis=1)
        return a, b, good.astype(float)

    a, b, good = rows(300, 0)
    pa, pb, _ = rows(600, 1)
    ta, tb, truth = rows(300, 1)
    left = np.ones(len(pa), bool)

    def surest(weights, share):
        out = []
        for v in (0, 1):
            p = op._sigmoid(op._raw(weights[v], (pa, pb)[v]))
            picked = [i for i in np.argsort(np.minimum(p, 1 - p)) if left[i] and min(p[i], 1 - p[i]) <= op.SURE][:37]
            left[picked] = False
            out.append(((pb, pa)[v][picked], (p[picked] >= 0.5).astype(float)))
        return out

    taught, alone = op.co_train([a, b], good, surest), op.co_train([a, b], good, surest, 0)
    right = lambda m: ((op._raw(m["weights"][1], tb) > 0) == truth).mean()
    assert right(taught) > 0.95 > right(alone)


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels")
    found = op.quality(table(spark, folder, "documents"), labels.where("doc_id % 2 = 0"))
    rows = found.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_pseudo_labels_are_the_surest_of_all_unlabelled(spark, monkeypatch):
    """What a view gives to the other, against a sort of the whole table on the driver."""
    labels = table(spark, "/root/testdata/sf0.01", "labels").where("doc_id % 3 = 0")
    views = op.viewed(table(spark, "/root/testdata/sf0.01", "documents"), labels)
    rows = {r.doc_id: r for r in views.where("good IS NULL").collect()}
    seen = []

    def spy(own, good, surest):
        weights = [op.logistic(x, good, np.ones(len(good))) for x in own]
        for _ in range(2):
            seen.append((weights, good.mean(), surest(weights, good.mean())))

    monkeypatch.setattr(op, "co_train", spy)
    op.train(views, each=40)
    ids, taken = sorted(rows), set()
    for weights, share, got in seen:
        for v in (0, 1):
            p = op._sigmoid(op._raw(weights[v], op._matrix([rows[i]["ab"[v]] for i in ids], v)))
            want = []
            for label, n in ((1.0, round(40 * share)), (0.0, round(40 * (1 - share)))):
                doubt = {i: 1 - x if label else x for i, x in zip(ids, p) if i not in taken}
                sure = sorted((d, i) for i, d in doubt.items() if d <= op.SURE)[:n]
                taken |= {i for _, i in sure}
                want += [label] * len(sure)
            assert want and list(got[v][1]) == want and got[v][0].shape == (len(want), (op.PLACES, op.PLACES + 3)[v])


def test_odd_rows(spark, frame):
    labels = table(spark, FOLDER, "labels").select("doc_id", "quality").unionAll(
        spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id BIGINT, quality INT"))
    docs = frame(ODD)
    none = op.quality(docs, labels.where("false"))
    assert none.where("kept AND score IS NULL").count() == len(ODD)
    every = docs.select("doc_id", "text").unionAll(table(spark, FOLDER, "documents").selectExpr("doc_id + 1000", "text"))
    got = op.quality(every, labels.selectExpr("doc_id + 1000 as doc_id", "quality")).collect()
    assert len(got) == every.count() and all(0 <= r.score <= 1 for r in got)
    assert op.quality(frame([]), labels).count() == 0
    kept = op.keep_good(every, labels.selectExpr("doc_id + 1000 as doc_id", "quality"))
    assert kept.schema == every.schema and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_query(spark):
    """The scores against the model applied to every document on the driver."""
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    model = op.train(op.viewed(docs, labels))
    want = {}
    for r in docs.collect():
        views = [op.text_view(r.text or ""), op.page_view(r.text or "", [r.source, r.lang])]
        want[r.doc_id] = op.score(model, [x[None].astype(np.float32).astype(float) for x in views])[0]
    found = op.op8_quality(spark, FOLDER).collect()
    assert len(found) == len(want)
    for r in found:
        assert abs(r.score - want[r.doc_id]) < 1e-9 and r.kept == (r.score >= model["threshold"])
