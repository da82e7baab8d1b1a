"""Toxicity: a factorization machine over hashed terms.

A document's terms (runs of letters, in lower case, and their beginnings of `STEM` letters) are hashed
to 2 ** `BITS` places. The score is a logistic function of a bias, a weight per place that occurs, and
for each pair of places the product of their `FACTORS` factors, so two terms that are harmless alone
can be toxic together. The pair sum takes linear time: half of the square of the sums less the sum of
squares.

The model is fitted on a bounded sample of labelled documents. Places in fewer than `LEAST` of them
have no weight, nor have those that tell nothing, so that a rare word can't stand for a label. A place
tells something if it is frequent, if it is more or less frequent in toxic documents than chance has it,
or if its pairs, learnt from one half of the sample with factors for every place, tell in the other
half what the places of the first two kinds leave open. All documents are then scored whole, in
one pass without a shuffle.
"""

import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.tables import bounded_sample, mapped, table, texts

SAMPLE, BITS, FACTORS, LEAST, SHARE, APART, PAIRED, STEM, EPOCHS, SEED = 12000, 20, 4, 6, 5, 3.0, 4.0, 4, 12, 11
TERMS = re.compile(r"[^\W\d_]+").findall
TERM_CACHE = 200_000
_PLACES: dict = {}


def _places(term: str) -> tuple[int, ...]:
    hashed = lambda t: zlib.crc32(t.encode("utf-8", "replace")) & (1 << BITS) - 1
    return (hashed(term), hashed(term[:STEM] + "*")) if len(term) > STEM else (hashed(term),)


def places(text: str) -> np.ndarray:
    """The distinct places of a text's terms, in order."""
    if len(_PLACES) > TERM_CACHE:
        _PLACES.clear()
    out = set()
    for term in set(TERMS(text.lower())):
        got = _PLACES.get(term)
        if got is None:
            got = _places(term)
            if len(term) <= 64:
                _PLACES[term] = got
        out.update(got)
    return np.sort(np.fromiter(out, np.int32, len(out)))


class Model:
    """Bias, and for the places that have any: weight and factors. Index `places[p]` is -1 for none."""

    def __init__(self, active: np.ndarray):
        self.index = np.full(1 << BITS, -1, np.int32)
        self.index[active] = np.arange(len(active), dtype=np.int32)
        self.bias, self.weight = 0.0, np.zeros(len(active), np.float32)
        self.factors = np.zeros((len(active), FACTORS), np.float32)

    def rows(self, documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Known places of all documents one after the other, and where each document begins and ends."""
        known = [x[x >= 0] for x in (self.index[d] for d in documents)]
        return (np.concatenate(known) if known else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum([len(x) for x in known])])

    def raw(self, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the logistic function, and the sums of factors."""
        linear, sums, squares = (
            _segments(v, ends) for v in (self.weight[at], self.factors[at], (self.factors[at] ** 2).sum(axis=1))
        )
        return self.bias + linear + 0.5 * ((sums ** 2).sum(axis=1) - squares), sums

    def scores(self, documents: list[np.ndarray]) -> np.ndarray:
        return _logistic(self.raw(*self.rows(documents))[0])


def _segments(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the rows of `values` between consecutive `ends`."""
    total = np.concatenate([np.zeros_like(values[:1], np.float64) if len(values) else np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends[1:]] - total[ends[:-1]]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _counts(documents: list[np.ndarray]) -> np.ndarray:
    return np.bincount(np.concatenate([np.zeros(0, np.int32), *documents]), minlength=1 << BITS)


def _telling(documents: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Places that tell taken alone: in `LEAST` documents or more, and either in one of `SHARE` of all or
    in toxic ones `APART` standard deviations more or less often than chance."""
    if not documents:
        return np.zeros(0, np.int64)
    seen, share = _counts(documents), toxic.mean()
    bad = _counts([d for d, t in zip(documents, toxic) if t])
    apart = np.abs(bad - share * seen) / np.sqrt(share * (1 - share) * seen + 1e-9)
    return np.flatnonzero((seen >= LEAST) & ((apart >= APART) | (seen >= len(documents) / SHARE)))


def _paired(documents: list[np.ndarray], toxic: np.ndarray, telling: np.ndarray, *how) -> np.ndarray:
    """Places in `LEAST` documents or more that tell by their pairs. Each half of the documents gives
    factors to all of them; a place is kept whose pair sums go, in the other half, with what a model of
    the `telling` places gets wrong, `PAIRED` standard deviations above chance."""
    every, half = np.flatnonzero(_counts(documents) >= LEAST), np.random.default_rng(SEED).permutation(len(documents)) % 2
    along, square = np.zeros(len(every)), np.full(len(every), 1e-12)
    for k in (0, 1):
        learnt, y = [d for d, h in zip(documents, half) if h == k], toxic[half == k]
        if not len(y) or y.all() or not y.any():
            return every[:0]
        judged = [d for d, h in zip(documents, half) if h != k]
        left = toxic[half != k] - _descend(Model(telling), learnt, y, *how).scores(judged)
        model = _descend(Model(every), learnt, y, *how)
        at, ends = model.rows(judged)
        sizes, v = np.diff(ends), model.factors[at]
        own = (v * (np.repeat(model.raw(at, ends)[1], sizes, axis=0) - v)).sum(axis=1)
        own -= (np.bincount(at, own, len(every)) / np.maximum(np.bincount(at, minlength=len(every)), 1))[at]
        own *= np.repeat(left, sizes)
        along += np.bincount(at, own, len(every))
        square += np.bincount(at, own ** 2, len(every))
    return every[along / np.sqrt(square) >= PAIRED]


def fit(documents: list[np.ndarray], toxic: np.ndarray, epochs: int = EPOCHS, rate: float = 1.0, decay: float = 1e-3, seed: int = SEED) -> Model:
    """The model of the places that tell, alone or by their pairs."""
    telling = _telling(documents, toxic)
    if not len(documents) or toxic.all() or not toxic.any():
        model = Model(telling)
        model.bias = 30.0 if len(documents) and toxic.all() else -30.0
        return model
    how = epochs, rate, decay, seed
    return _descend(Model(np.union1d(telling, _paired(documents, toxic, telling, *how))), documents, toxic, *how)


def _descend(model: Model, documents: list[np.ndarray], toxic: np.ndarray, epochs: int, rate: float, decay: float, seed: int) -> Model:
    """Minibatch AdaGrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    model.bias = float(np.log(toxic.mean() / (1 - toxic.mean())))
    model.factors[:] = rng.normal(0, 0.01, model.factors.shape)
    w2, f2, b2 = np.full(len(model.weight), 1e-6), np.full(model.factors.shape, 1e-6), 1e-6
    at, ends = model.rows(documents)
    for _ in range(epochs):
        order = rng.permutation(len(documents))
        for part in np.array_split(order, max(1, len(order) // 64)):
            some = np.concatenate([at[ends[d]:ends[d + 1]] for d in part])
            sizes = ends[part + 1] - ends[part]
            raw, sums = model.raw(some, np.concatenate([[0], np.cumsum(sizes)]))
            error = _logistic(raw) - toxic[part]
            e = np.repeat(error, sizes)
            used, back = np.unique(some, return_inverse=True)
            gw = np.bincount(back, e, len(used)) / len(part) + decay * model.weight[used]
            w2[used] += gw ** 2
            model.weight[used] -= rate * gw / np.sqrt(w2[used])
            spread = np.repeat(sums, sizes, axis=0)
            v = model.factors[used]
            ee = np.bincount(back, e, len(used))
            gf = np.stack([np.bincount(back, e * spread[:, k], len(used)) for k in range(FACTORS)], axis=1)
            gf = (gf - ee[:, None] * v) / len(part) + decay * v
            f2[used] += gf ** 2
            model.factors[used] -= 0.1 * rate * gf / np.sqrt(f2[used])
            gb = error.mean()
            b2 += gb ** 2
            model.bias -= rate * gb / np.sqrt(b2)
    return model


def held_out() -> Column:
    """One document in five, by the digest of its id, is never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from at most `sample` labelled documents that are not held out. Labels that are null
    or contradict each other for a `doc_id` are left out; without any, all scores are 0 but for rounding."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("toxic").alias("toxic"), F.max("toxic").alias("most")
    ).where("toxic = most").where(~held_out()).select(F.col("doc_id").alias("id"), "toxic")
    chosen = F.broadcast(bounded_sample(known, sample, "id"))
    rows = texts(docs).join(chosen, F.col("doc_id") == F.col("id")).select("doc_id", "text", F.col("toxic").cast("int"))

    def each(batch):
        found = [places(t).tobytes() for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "toxic": batch["toxic"], "places": found}

    made = mapped(rows, each, "doc_id BIGINT, toxic INT, places BINARY")
    found = made.orderBy(F.xxhash64("doc_id"), "doc_id", "places").limit(sample).collect()
    return fit([np.frombuffer(r.places, np.int32) for r in found], np.array([r.toxic == 1 for r in found], dtype=float))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """`doc_id` and `score` (0 to 1, higher: more likely toxic) of every document.

    Only the text is scored. Null and empty texts, and those without letters, get the score of the
    bias. Rows with a null or repeated `doc_id` are each scored; other columns are ignored; an empty
    table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def each(batch):
        return {"doc_id": batch["doc_id"], "score": shared.value.scores([places(t) for t in batch["text"].to_pylist()])}

    return mapped(texts(docs), each, "doc_id BIGINT, score DOUBLE")


def op10_toxicity(spark, folder: str) -> DataFrame:
    found = toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
