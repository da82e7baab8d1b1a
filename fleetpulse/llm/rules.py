"""Quality rules: statistics of a text, and an isolation forest that finds texts with odd ones.

Statistics are taken of every document once and written. The forest is fitted on all labelled
documents that pass the base rules. Each tree splits the box of their statistics at random places; a
part is split on while it holds more than one in `TREE_ROWS` of the good ones, so a row that random
splits soon part from the good ones has a short path. (With splits drawn between good rows alone, a
statistic that is constant among them would never be split, and what shows only there would not be
found.) Splits don't depend on the rows, so `AHEAD` levels of them are drawn at once, Spark counts the
good rows in each part, and splits of parts with too few are taken back: a tree's size is bounded, the
number of rows isn't. The threshold is calibrated on all labels, good and bad, counted by score. Scores
are multiples of 1 / `STEPS`, so the counts are few however many documents there are.
"""

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.tables import mapped, table, texts, written

TREES, TREE_ROWS, DEPTH, AHEAD, STEPS, SEED = 100, 256, 20, 4, 1 << 16, 7
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_marks", "n_same_next", "n_distinct")
FEATURES = ("symbols", "upper", "marks", "same_next", "dup_lines", "repeats", "few_distinct")
WINDOW = 8


def repeat_words(words: list[str], size: int = WINDOW) -> int:
    """Words in windows of `size` words that are found twice or more, by doubling the ranks of runs."""
    if len(words) <= size:
        return 0
    ids: dict = {}
    rank = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    if len(ids) == len(words):
        return 0
    for step in (1, 2, 4):
        rank = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        found, rank, times = np.unique(rank, return_inverse=True, return_counts=True)
        if len(found) == len(rank):
            return 0
    at = np.flatnonzero(times[rank] > 1)
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str) -> tuple[int, ...]:
    """`COUNTS`, then `MORE`."""
    words = WORDS(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n_symbols = sum(map(text.count, SYMBOLS))
    marks = sum(map(text.count, "!?=;:{}[]_~^\\"))
    upper = sum(map(str.isupper, words))
    same = sum(a == b for a, b in zip(words, words[1:]))
    return (
        len(words), sum(map(len, words)), n_symbols, len(lines) - len(set(lines)), repeat_words(words),
        len(lines), upper, marks, same, len(set(words)),
    )


def rates(stats: np.ndarray) -> np.ndarray:
    """The rows of `FEATURES`, each from 0 to 1, from rows of `COUNTS` and `MORE`; none depends on the
    length alone. Rates whose small values already tell are bent, so that half of the range is theirs."""
    s = dict(zip(COUNTS + MORE, stats.astype(float).T))
    words = np.maximum(s["n_words"], 1)
    bent = lambda count, half: count / (count + half * words)
    # Long texts use fewer distinct words: measured against what a text of that length may have.
    expected = np.minimum(words, 6 * np.sqrt(words))
    return np.stack([
        bent(s["n_symbols"], 0.05), bent(s["n_upper"], 0.2), bent(s["n_marks"], 0.1), bent(s["n_same_next"], 0.2),
        s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / words,
        np.maximum(1 - s["n_distinct"] / expected, 0),
    ], axis=1)


def _mean_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary tree of `n` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Part:
    """A part of the box: its bounds, how many splits made it, how many rows it holds, and its own
    split, if any, as feature, place and both parts."""

    def __init__(self, low: tuple, high: tuple, level: int = 0, rows: int = 0):
        self.low, self.high, self.level, self.rows, self.cut = low, high, level, rows, None

    def split(self, rng, levels: int) -> None:
        if levels and self.level < DEPTH:
            f = int(rng.integers(len(self.low)))
            cut = float(rng.uniform(self.low[f], self.high[f]))
            inner = lambda box: box[:f] + (cut,) + box[f + 1:]
            sides = Part(self.low, inner(self.high), self.level + 1), Part(inner(self.low), self.high, self.level + 1)
            self.cut = f, cut, *sides
            for side in sides:
                side.split(rng, levels - 1)

    def within(self) -> list["Part"]:
        """This part and all that it is split into, each before its own."""
        out = [self]
        for part in out:
            out += part.cut[2:] if part.cut else ()
        return out


def _tree(parts: list[Part], share: float) -> tuple[np.ndarray, ...]:
    """Parts as `within` gives them, as arrays (feature or -1, split, left, right, path at a leaf)."""
    nodes, after = [], 1
    for part in parts:
        if part.cut:
            nodes.append((*part.cut[:2], after, after + 1, 0.0))
            after += 2
        else:
            nodes.append((-1, 0.0, 0, 0, part.level + _mean_path(round(part.rows * share))))
    return tuple(map(np.array, zip(*nodes)))


def grown(ends, rows: int, low, high, rng, trees: int = TREES) -> list[tuple[np.ndarray, ...]]:
    """Trees over the box from `low` to `high`, fitted on `rows` rows. `ends(forest)` gives how many of
    them end at each node, as `_counted` has it."""
    share = min(TREE_ROWS, rows) / rows
    roots = [Part(tuple(map(float, low)), tuple(map(float, high)), rows=rows) for _ in range(trees)]
    for _ in range(0, DEPTH, AHEAD):
        wide = [p for root in roots for p in root.within() if not p.cut and p.rows * share > 1]
        if not wide:
            break
        for part in wide:
            part.split(rng, AHEAD)
        forest = [root.within() for root in roots]
        every = [p for parts in forest for p in parts]
        for part, n in zip(every, ends([_tree(parts, share) for parts in forest])):
            part.rows = int(n)
        for part in reversed(every):
            if part.cut:
                part.rows = part.cut[2].rows + part.cut[3].rows
                part.cut = part.cut if part.rows * share > 1 else None
    return [_tree(root.within(), share) for root in roots]


def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng, trees: int = TREES) -> list[tuple[np.ndarray, ...]]:
    """The same where all rows are at hand."""
    return grown(lambda forest: _counted(forest, rows), len(rows), low, high, rng, trees)


def _walk(tree, rows: np.ndarray) -> np.ndarray:
    """The node at which each row ends."""
    f, cut, left, right, _ = tree
    at = np.zeros(len(rows), np.int64)
    while (inner := f[at] >= 0).any():
        go = np.flatnonzero(inner)
        here = at[go]
        at[go] = np.where(rows[go, f[here]] < cut[here], left[here], right[here])
    return at


def _counted(forest, rows: np.ndarray) -> np.ndarray:
    """How many rows end at each node of each tree, one tree after the other."""
    return np.concatenate([np.bincount(_walk(tree, rows), minlength=len(tree[0])) for tree in forest])


def anomaly(forest, rows: np.ndarray, tree_rows: int) -> np.ndarray:
    """2 ** -(mean path / expected path): the nearer to 1, the odder the row."""
    total = np.zeros(len(rows))
    for tree in forest:
        total += tree[-1][_walk(tree, rows)]
    return 2.0 ** -(total / max(len(forest), 1) / max(_mean_path(tree_rows), 1e-9))


def calibrated(scores: np.ndarray, good: np.ndarray, most_lost: float = 0.01, times: np.ndarray | None = None) -> float:
    """The threshold above which rows are rejected: best balance of both classes' shares, among
    thresholds that reject at most `most_lost` of the good rows. Without both classes, nothing is rejected.
    A row counts `times` times."""
    if not good.any() or good.all():
        return np.inf
    times = np.ones(len(scores)) if times is None else times
    order, at = np.unique(scores, return_inverse=True)
    cuts = np.concatenate([(order[1:] + order[:-1]) / 2, [np.inf]])
    upto = [np.cumsum(np.bincount(at, times * side, len(order))) for side in (good, ~good)]
    lost, caught = ((n[-1] - n) / n[-1] for n in upto)
    allowed = lost <= most_lost
    return float(cuts[allowed][np.argmax((caught - lost)[allowed])])


def with_statistics(docs: DataFrame) -> DataFrame:
    """`doc_id`, `COUNTS` and `MORE` of every document, all long."""
    names = COUNTS + MORE

    def each(batch):
        return {"doc_id": batch["doc_id"]} | _columns(batch, names)

    return mapped(texts(docs), each, "doc_id BIGINT, " + ", ".join(f"{n} BIGINT" for n in names))


def _columns(batch, names) -> dict:
    rows = [statistics(t) for t in batch["text"].to_pylist()]
    return dict(zip(names, zip(*rows)))


def _matrix(batch, names) -> np.ndarray:
    return np.stack([batch[n].to_numpy(zero_copy_only=False) for n in names], axis=1)


def _score(forest, size: int, rows: np.ndarray) -> np.ndarray:
    return np.round(anomaly(forest, rows, size) * STEPS) / STEPS


def fit(stats: DataFrame, labels: DataFrame, seed: int = SEED):
    """(forest, rows a tree stands for, threshold) from all rows of `with_statistics` that are labelled
    (`doc_id`, `quality`, 1 for good). Labels that are null or contradict each other for a `doc_id` are
    left out. Without good labelled documents the forest is empty and nothing is rejected."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.min("quality").alias("quality"), F.max("quality").alias("most")
    ).where("quality = most").select("id", (F.col("quality") == 1).alias("good"))
    rows = stats.where(~base_failed()).join(known, F.col("doc_id") == F.col("id"))

    def rated(batch):
        return dict(zip(FEATURES, rates(_matrix(batch, COUNTS + MORE)).T)) | {"good": batch["good"]}

    rows = written(mapped(rows, rated, ", ".join(f"{n} DOUBLE" for n in FEATURES) + ", good BOOLEAN"), "labelled")
    good = rows.where("good")
    box = rows.agg(F.count_if("good"), *(f(n) for f in (F.min, F.max) for n in FEATURES)).first()
    if not box[0]:
        return [], 0, np.inf
    context, low, high = stats.sparkSession.sparkContext, box[1:len(FEATURES) + 1], box[len(FEATURES) + 1:]

    def ends(forest):
        shared = context.broadcast(forest)

        def each(batch):
            n = _counted(shared.value, _matrix(batch, FEATURES))
            return {"node": np.flatnonzero(n), "n": n[n > 0]}

        out = np.zeros(sum(len(tree[0]) for tree in forest), np.int64)
        for r in mapped(good, each, "node BIGINT, n BIGINT").groupBy("node").agg(F.sum("n").alias("n")).collect():
            out[r.node] = r.n
        shared.destroy()
        return out

    forest, size = grown(ends, box[0], low, high, np.random.default_rng(seed)), min(TREE_ROWS, box[0])
    shared = context.broadcast(forest)

    def scored(batch):
        return {"score": _score(shared.value, size, _matrix(batch, FEATURES)), "good": batch["good"]}

    found = mapped(rows, scored, "score DOUBLE, good BOOLEAN").groupBy("score", "good").agg(F.count("*").alias("n")).collect()
    scores, sides, times = (np.array([r[n] for r in found]) for n in ("score", "good", "n"))
    return forest, size, calibrated(scores, sides, times=times)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`doc_id`, `COUNTS`, `MORE`, `anomaly`, `base_failed` and `kept` of every document.

    The base fails a document of under 20 words or with over 30 of 100 words in repeated windows;
    any other is kept unless its anomaly is above the threshold. Null text has no words, so it fails
    the base; empty texts likewise. Rows with a null or repeated `doc_id` each get their row; other
    columns are ignored; without labels the base decides alone.
    """
    stats = written(with_statistics(docs), "statistics")
    forest, size, threshold = fit(stats, labels)
    shared = docs.sparkSession.sparkContext.broadcast((forest, size))

    def each(batch):
        return batch | {"anomaly": _score(*shared.value, rates(_matrix(batch, COUNTS + MORE)))}

    made = mapped(stats, each, ", ".join(f"{n} BIGINT" for n in ("doc_id", *COUNTS, *MORE)) + ", anomaly DOUBLE")
    odd = F.col("anomaly") > F.lit(threshold)
    return made.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~odd)


def op3_quality_rules(spark, folder: str) -> DataFrame:
    found = quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "anomaly")
