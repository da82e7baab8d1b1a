import random
import re

import numpy as np
from pyspark.sql import functions as F

from conftest import FOLDER
from fleetpulse.llm import rules as op
from fleetpulse.llm.tables import table
from llm.conftest import ODD

COUNTS = list(op.COUNTS)


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    repeated = {k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(i, i + 8)}
    return [
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)), len(repeated),
    ]


def test_counts(spark, frame):
    rng = random.Random(1)
    docs = ODD + [(100 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    docs += [(300 + i, "\n".join(rng.choice(["a b", "a  b", "", " ", "c|d", "a b\r"]) for _ in range(20))) for i in range(30)]
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (5, 1), (5, 0)], "doc_id BIGINT, quality INT")
    found = op.quality_rules(frame(docs), labels).collect()
    assert sorted((str(r.doc_id), [r[c] for c in COUNTS]) for r in found) == sorted((str(i), plain_counts(t)) for i, t in docs)
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in found)
    assert not any(r.kept and r.base_failed for r in found)
    none = labels.where("false")
    assert all(r.kept != r.base_failed for r in op.quality_rules(frame(docs), none).collect())
    assert op.quality_rules(frame([]), none).count() == 0


def test_paths_are_those_of_a_walk():
    rng = np.random.default_rng(1)
    rows = rng.random((200, 3))
    forest = op.grow(rows, rows.min(axis=0), rows.max(axis=0), rng, 5)

    def walk(tree, row):
        f, cut, left, right, path = tree
        at = 0
        while f[at] >= 0:
            at = left[at] if row[f[at]] < cut[at] else right[at]
        return path[at]

    want = [2 ** -(np.mean([walk(t, r) for t in forest]) / op._mean_path(200)) for r in rows]
    assert np.allclose(op.anomaly(forest, rows, 200), want)


def test_threshold():
    scores, good = np.array([0.1, 0.2, 0.3, 0.8, 0.9]), np.array([True, True, True, False, False])
    assert 0.3 < op.calibrated(scores, good) < 0.8
    assert op.calibrated(scores, np.array([True] * 5)) == np.inf


def test_held_out_documents(spark):
    """Fitted on half of the labels, the verdict fits the other half."""
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    found = op.quality_rules(docs, labels.where("doc_id % 2 = 0")).select("doc_id", "kept", "base_failed")
    rows = found.join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_all_labels_are_fitted(spark, frame):
    """Bad documents that come last by the hash of their id, behind 4,100 good ones, still set the threshold."""
    rng, words = random.Random(2), [f"w{c}{d}" for c in "abcdefgh" for d in "klmnopqr"]
    ids = [r.id for r in spark.range(4200).orderBy(F.xxhash64("id")).collect()]
    bad = set(ids[4100:])
    text = lambda i: " ".join(rng.sample([w.upper() + "#" for w in words] if i in bad else words, 30))
    docs = frame([(i, text(i)) for i in ids], False)
    labels = spark.createDataFrame([(i, int(i not in bad)) for i in ids], "doc_id BIGINT, quality INT")
    assert {r.doc_id for r in op.quality_rules(docs, labels).where("not kept").collect()} == bad


def test_fit_is_that_of_all_rows_at_hand(spark):
    docs, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    stats = op.with_statistics(docs)
    forest, size, threshold = op.fit(stats.repartition(5), labels)
    found = stats.where(~op.base_failed()).join(labels, "doc_id").collect()
    x = op.rates(np.array([[r[c] for c in op.COUNTS + op.MORE] for r in found]))
    good = np.array([r.quality == 1 for r in found])
    want = op.grow(x[good], x.min(axis=0), x.max(axis=0), np.random.default_rng(op.SEED))
    assert size == min(op.TREE_ROWS, good.sum()) and len(forest) == len(want) == op.TREES
    assert all(np.array_equal(a, b) for t, u in zip(forest, want) for a, b in zip(t, u))
    assert threshold == op.calibrated(np.round(op.anomaly(want, x, size) * op.STEPS) / op.STEPS, good) < 1


def test_trees_stay_bounded():
    """A part is split while it holds more than one in `TREE_ROWS` of the rows, however many those are."""
    rows = np.random.default_rng(3).random((5_000, 2))
    few, many = (op.grow(x, rows.min(axis=0), rows.max(axis=0), np.random.default_rng(4), 3) for x in (rows, np.tile(rows, (10, 1))))
    assert all(np.array_equal(a, b) for t, u in zip(few, many) for a, b in zip(t, u))
    for tree in few:
        held = np.bincount(op._walk(tree, rows), minlength=len(tree[0]))
        assert held.sum() == 5_000 and held[tree[-1] < op.DEPTH].max() * op.TREE_ROWS <= 5_000


def test_threshold_of_counted_scores():
    rng = np.random.default_rng(5)
    scores, good = rng.integers(0, 30, 3000) / 30, rng.random(3000) < 0.9
    pairs, times = np.unique(np.stack([scores, good]), axis=1, return_counts=True)
    for most_lost in (0.01, 0.3):
        assert op.calibrated(pairs[0], pairs[1] == 1, most_lost, times) == op.calibrated(scores, good, most_lost)


def test_query(spark):
    found = {r.doc_id: [r[c] for c in COUNTS] for r in op.op3_quality_rules(spark, FOLDER).collect()}
    for r in table(spark, FOLDER, "documents").where("length(text) < 6000").collect():
        assert found[r.doc_id] == plain_counts(r.text)
