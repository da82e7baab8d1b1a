import random
import zlib

import numpy as np

from conftest import FOLDER
from fleetpulse.llm import toxicity as op
from fleetpulse.llm.tables import table
from llm.conftest import ODD


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    model = op.Model(np.arange(0, 60, 2))
    model.bias, model.weight, model.factors = 0.3, rng.normal(0, 0.2, 30).astype("f4"), rng.normal(0, 0.3, (30, op.FACTORS)).astype("f4")
    docs = [np.array(sorted(rng.choice(60, n, replace=False)), np.int32) for n in (0, 1, 5, 20)]
    want = []
    for d in docs:
        k = [p // 2 for p in d if p % 2 == 0]
        x = 0.3 + sum(model.weight[i] for i in k) + sum(model.factors[a] @ model.factors[b] for n, a in enumerate(k) for b in k[:n])
        want.append(1 / (1 + np.exp(-x)))
    assert np.allclose(model.scores(docs), want, atol=1e-5)


def test_pairs_that_no_weight_can_tell():
    """Toxic if both or neither of two terms occur: additive weights can't tell, factors can."""
    rng, docs, toxic = random.Random(3), [], []
    for _ in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        docs.append(op.places(" ".join((["insult"] if a else []) + (["group"] if b else []) + rng.choices("uno due tre quattro cinque".split(), k=2))))
        toxic.append(float(a == b))
    model = op.fit(docs, np.array(toxic), epochs=60, decay=0.0)
    right = (model.scores(docs) >= 0.5) == (np.array(toxic) == 1)
    assert right.mean() > 0.95


def test_rare_pairs():
    """Two terms, each in 3% of documents: harmless alone, toxic together, and half of those with either
    toxic, as of all others, so that neither tells anything taken alone."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(1500)]

    def rows(n):
        kinds = rng.choices(["insult", "group", "insult group", "curse", ""], [1.5, 1.5, 1.5, 47.75, 47.75], k=n)
        docs = [op.places(" ".join([k, *rng.choices(words, k=40)])) for k in kinds]
        return docs, np.array([float(k in ("insult group", "curse")) for k in kinds]), np.array(kinds)

    docs, toxic, _ = rows(8000)
    pair = set(np.concatenate([op.places("insult"), op.places("group")]).tolist())
    assert not pair & set(op._telling(docs, toxic).tolist())
    model = op.fit(docs, toxic)
    docs, toxic, kinds = rows(4000)
    right = (model.scores(docs) >= 0.5) == (toxic == 1)
    assert all(right[kinds == k].mean() > 0.95 for k in set(kinds))


def test_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    rows = op.op10_toxicity(spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out").collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic == 1 for r in rows])
    rank = np.argsort(np.argsort(score))
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() - 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.95 and ((score >= 0.5) & ~toxic).mean() < 0.05
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_odd_rows(spark, frame):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (6, 0), (None, 1), (7, None)], "doc_id BIGINT, toxic INT")
    found = op.toxicity(frame(ODD), labels).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in ODD) and all(0 <= r.score <= 1 for r in found)
    assert all(r.score < 0.5 for r in op.toxicity(frame(ODD), labels.where("false")).collect())
    assert op.toxicity(frame([]), labels).count() == 0


def test_query(spark):
    found = op.op10_toxicity(spark, FOLDER).collect()
    assert len(found) == table(spark, FOLDER, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 for r in found)
