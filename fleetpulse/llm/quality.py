"""Quality classifier by co-training two views of a document.

The *text* view sees the shapes of words (runs of lower and upper case letters and digits as one sign
each, other characters as they are) and how much a text repeats itself. The *page* view sees what a
crawl knows without reading: source, language, length, and the layout of lines. Each is a logistic
model. Both are fitted on labelled documents; then, over rounds, each labels the unlabelled documents
that it is most sure of, and the other is fitted again with them. At the end each
view's score is calibrated on labelled documents that no fit has seen, and a logistic combination of
both scores every document.

Labelled documents are a bounded sample (`SAMPLE`). The views of all documents are computed once and
written; each round scores every unlabelled one of them in Spark and takes the `EACH` surest of a view,
in the proportion of the labels. Only these, and the labelled sample, reach the driver.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.tables import bounded_sample, mapped, small_batches, table, written

SAMPLE, EACH, ROUNDS, SURE, MOST_LOST, PLACES = 4000, 125, 4, 0.1, 0.005, 128
PAGE = ("source", "lang")
_RUNS = [(re.compile(p), s) for p, s in (("[^\\W\\d_A-Z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), (r"(.)\1+", r"\1"))]
_SHAPES: dict = {}
SHAPES = 200_000


def _place(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % PLACES


def _shape_place(word: str) -> int:
    got = _SHAPES.get(word)
    if got is None:
        shape = word
        for pattern, sign in _RUNS:
            shape = pattern.sub(sign, shape)
        got = _place(shape)
        if len(_SHAPES) > SHAPES:
            _SHAPES.clear()
        if len(word) <= 64:
            _SHAPES[word] = got
    return got


def text_view(text: str) -> np.ndarray:
    """Roots of the shares of word shapes, and three rates of repetition."""
    words = text.split()
    out = np.zeros(PLACES + 3)
    counts = Counter(words)
    for word, n in counts.items():
        out[_shape_place(word)] += n
    n = max(len(words), 1)
    out[:PLACES] = np.sqrt(out[:PLACES] / n)
    out[PLACES] = max(0.0, 1 - len(counts) / min(n, 6 * n ** 0.5))
    out[PLACES + 1] = sum(a == b for a, b in zip(words, words[1:])) / n
    out[PLACES + 2] = max(counts.values(), default=0) / n
    return out


def page_view(text: str, page: list) -> np.ndarray:
    """Metadata and layout as indicators: each value, or step of a size, is one place."""
    out = np.zeros(PLACES)
    lines = [x for x in text.split("\n") if x.strip()]
    chars = max(len(text), 1)
    marks = sum(map(text.count, "!#*$%&|<>"))
    steps = {
        "chars": np.log2(chars) // 1, "lines": np.log2(len(lines) + 1) // 1, "line": np.log2(chars / (len(lines) + 1) + 1) // 1,
        "same": 10 * (1 - len(set(lines)) / len(lines)) // 1 if lines else -1, "gaps": 50 * text.count(" ") / chars // 1,
        "marks": np.ceil(np.log2(1 + 200 * marks / chars)),
    }
    for name, value in [*zip(PAGE, page), *steps.items()]:
        out[_place(f"{name}={value}")] = 1
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights (bias last) of ridge-penalised logistic regression, by Newton's method. `y` may be soft."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _raw(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def co_train(views: list[np.ndarray], good: np.ndarray, surest, rounds: int = ROUNDS) -> dict:
    """Weights of both views, of their combination, and the threshold, from two views of labelled rows.
    Every third labelled row is kept for calibration.

    `surest(weights, share)` gives, for each view, what it labels for the other in a round: the rows of
    the other view and their labels. A document is given once."""
    hold = np.arange(len(good)) % 3 == 2
    fit = ~hold
    share = good[fit].mean()
    given: list = [[], []]  # (rows, labels) that a view has got

    def fitted(v: int) -> np.ndarray:
        rows = np.concatenate([views[v][fit], *[r for r, _ in given[v]]])
        y = np.concatenate([good[fit], *[label for _, label in given[v]]])
        return logistic(rows, y, np.where(np.arange(len(y)) < fit.sum(), 1.0, 0.5))

    weights = [fitted(0), fitted(1)]
    for _ in range(rounds):
        for v, (rows, labels) in enumerate(surest(weights, share)):
            if len(labels):
                given[1 - v].append((rows, labels))
        weights = [fitted(0), fitted(1)]
    held = np.stack([_raw(w, x[hold]) for w, x in zip(weights, views)], axis=1)
    scales = [logistic(held[:, v:v + 1], good[hold], np.ones(hold.sum()), 0.01) for v in (0, 1)]
    calibrated = np.stack([_raw(s, held[:, v:v + 1]) for v, s in enumerate(scales)], axis=1)
    both = logistic(calibrated, good[hold], np.ones(hold.sum()), 0.1)
    model = {"weights": weights, "scales": scales, "both": both, "threshold": 0.5}
    every = score(model, views)
    # At most `MOST_LOST` of good labelled rows may be rejected.
    model["threshold"] = float(min(0.5, np.quantile(every[good == 1], MOST_LOST)))
    return model


def score(model: dict, views: list[np.ndarray]) -> np.ndarray:
    calibrated = np.stack([_raw(s, _raw(w, x)[:, None]) for w, s, x in zip(model["weights"], model["scales"], views)], axis=1)
    return _sigmoid(_raw(model["both"], calibrated))


def _page(docs: DataFrame) -> list[Column]:
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in PAGE]


def _views(batch) -> list[np.ndarray]:
    found = [[], []]
    for text, *page in zip(*(batch[c].to_pylist() for c in ("text", *PAGE))):
        found[0].append(text_view(text or ""))
        found[1].append(page_view(text or "", page))
    return [np.array(found[0]), np.array(found[1])]


def known_labels(labels: DataFrame) -> DataFrame:
    """`id` and `good` of documents whose labels are there and agree."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
    return rows.agg(F.min("quality").alias("good"), F.max("quality").alias("most")).where("good = most").select("id", F.col("good").cast("int"))


def viewed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, both views (`a`, `b`, packed) and `good` of every document, written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *_page(docs))

    def each(batch):
        views = [v.astype(np.float32) for v in _views(batch)]
        return {"doc_id": batch["doc_id"]} | {n: [r.tobytes() for r in v] for n, v in zip("ab", views)}

    made = mapped(rows, each, "doc_id BIGINT, a BINARY, b BINARY")
    # Rows without an id have no label; their views deal them out.
    key = F.coalesce("doc_id", F.xxhash64("a", "b"))
    found = made.join(known_labels(labels).hint("shuffle_hash"), key == F.col("id"), "left")
    return written(found.select("doc_id", "a", "b", F.when(F.col("doc_id").isNotNull(), F.col("good")).alias("good")), "views")


def _matrix(packed, v: int) -> np.ndarray:
    width = (PLACES + 3, PLACES)[v]
    return np.frombuffer(b"".join(packed), np.float32).reshape(-1, width).astype(float)


def train(views: DataFrame, sample: int = SAMPLE, each: int = EACH) -> dict | None:
    """The model from at most `sample` labelled rows of `viewed`; each view gives the other at most
    `each` pseudo-labels a round, the surest of all unlabelled rows. Labels that are null or contradict
    each other for a `doc_id` are left out. None if a class has under 10 labelled documents."""
    known = views.where("good IS NOT NULL")
    # Every task sends the driver its own first rows; a share of about twice the sample keeps that bounded.
    every = max(known.count() // (2 * sample), 1)
    known = known.where(F.pmod(F.xxhash64("a", "doc_id"), F.lit(every)) == 0)
    labelled = bounded_sample(known, sample, "doc_id", "a").collect()
    good = np.array([float(r.good == 1) for r in labelled])
    if min(good.sum(), len(good) - good.sum()) < 10:
        return None
    free = views.where("good IS NULL AND doc_id IS NOT NULL")
    taken: set[int] = set()

    def surest(weights, share):
        shared = views.sparkSession.sparkContext.broadcast(weights)

        def scores(batch):
            raw = [_sigmoid(_raw(w, _matrix(batch[n].to_pylist(), v))) for v, (n, w) in enumerate(zip("ab", shared.value))]
            return {"doc_id": batch["doc_id"], "p": raw[0], "q": raw[1]}

        scored = mapped(free, scores, "doc_id BIGINT, p DOUBLE, q DOUBLE").where(~F.col("doc_id").isin(sorted(taken)))
        picked: list = [[], []]
        sides = [(v, label, n) for v in (0, 1) for label, n in ((1.0, round(each * share)), (0.0, round(each * (1 - share))))]
        for v, label, n in sides:
            doubt = (1 - F.col("pq"[v])) if label else F.col("pq"[v])
            top = scored.select("doc_id", doubt.alias("doubt")).where(F.col("doubt") <= SURE)
            # What the other side takes before is passed over, so as many more are asked for.
            for r in top.groupBy("doc_id").agg(F.min("doubt").alias("doubt")).orderBy("doubt", F.xxhash64("doc_id")).limit(n + 2 * each).collect():
                if n and r.doc_id not in taken:
                    taken.add(r.doc_id)
                    picked[v].append((r.doc_id, label))
                    n -= 1
        of = dict(picked[0]) | dict(picked[1])
        rows = {r.doc_id: r for r in free.where(F.col("doc_id").isin(sorted(of))).groupBy("doc_id").agg(
            F.min(F.struct("a", "b")).alias("x")).select("doc_id", "x.*").collect()} if of else {}
        return [
            (_matrix([rows[i]["ba"[v]] for i, _ in picked[v]], 1 - v), np.array([label for _, label in picked[v]])) for v in (0, 1)
        ]

    return co_train([_matrix([r[n] for r in labelled], v) for v, n in enumerate("ab")], good, surest)


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, each: int = EACH) -> DataFrame:
    """`doc_id`, `score` (0 to 1, higher: better) and `kept` of every document.

    Null text counts as empty, and missing or null `source` and `lang` as values of their own. Rows
    with a null or repeated `doc_id` are each scored; other columns are ignored; an empty table gives
    no row. Without enough labels the score is null and all are kept.
    """
    views = viewed(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(train(views, sample, each))

    def scored(batch):
        model = shared.value
        n = len(batch["doc_id"])
        found = None if model is None else score(model, [_matrix(batch[c].to_pylist(), v) for v, c in enumerate("ab")])
        return {
            "doc_id": batch["doc_id"], "score": [None] * n if found is None else found,
            "kept": [True] * n if found is None else found >= model["threshold"],
        }

    return mapped(views, scored, "doc_id BIGINT, score DOUBLE, kept BOOLEAN")


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, each: int = EACH) -> DataFrame:
    """The rows of `docs` that `quality` keeps, with all their columns; null and empty texts are judged
    as empty, and all rows stay where there are not enough labels."""
    shared = docs.sparkSession.sparkContext.broadcast(train(viewed(docs, labels), sample, each))
    small_batches(docs.sparkSession)
    page = [c if c in docs.columns else None for c in PAGE]

    def run(batches):
        model = shared.value
        for batch in batches:
            if model is None or not batch.num_rows:
                yield batch
                continue
            nothing = pa.nulls(batch.num_rows, pa.string())
            own = {"text": batch.column("text")} | {
                n: batch.column(c).cast(pa.string()) if c else nothing for n, c in zip(PAGE, page)
            }
            views = [v.astype(np.float32).astype(float) for v in _views(own)]  # as they are written
            yield batch.filter(pa.array(score(model, views) >= model["threshold"]))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
