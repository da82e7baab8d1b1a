"""Secret scans with a random forest that removes false positives.

Candidates are runs of `LEAST` or more key characters with a digit, or with a capital after a small
letter, and whatever is assigned to a name of a secret, of any length and alphabet. A '=' parts a name
from its value; only at the end of a run is it padding. Each candidate is described by its length, how
often its characters change class, how much of it words of a dictionary cover, its path (here the source
of the document) and the words beside it. The dictionary is counted over all documents. The forest is
trained on labelled findings, a bounded sample; every candidate of every document is then scored.

Where no table holds labelled findings, `seeds` labels what it can be sure of: a value assigned to a name
of a secret is one, and what does not look like a key is none. A key-like value that stands bare is left
to the forest, which then does not see whether a name stands before (`OF_NAME`): it tells bare keys by
what assigned ones look like.
"""

import math
import re
import unicodedata
import zlib

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.tables import bounded_sample, mapped, table, written
from fleetpulse.operators.sizing import limit_of

LEAST, SAMPLE, TREES, DEPTH, SEED, NEAR, PLACES = 16, 4000, 30, 6, 3, 40, 8
#: Words of the dictionary: their letters, and the least share of all documents that have one.
SHORT, LONG, SHARE = 4, 32, 1e-4
KEYS = "[A-Za-z0-9+/_-]"
CANDIDATE = re.compile(
    rf"(?<!{KEYS})(?={KEYS}*[0-9]|[A-Z+/_-]*[a-z][a-z+/_-]*[A-Z]){KEYS}{{{LEAST},}}(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?"
)
#: Words that name a secret when a value is assigned to them.
NAMES = "token secret key password passwd pwd credential auth bearer".split()
ASSIGNED = re.compile(rf"(?i)(?:{'|'.join(NAMES)})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?$")
#: A whole name and its sign; where in it a secret is named, with what may follow (`password_for_service`,
#: `keyId`); then the value: in quotes, or up to a blank, a quote or the next field (`&page=`, `,user:`).
SIGNED = re.compile(r"(?<![\w.-])([\w.-]++)[\"']?\s{0,3}[=:]{1,3}>?")
NAMED = re.compile(rf"(?i)(?:{'|'.join(NAMES)})s?(?:(?-i:[A-Z0-9_.-])|\Z)")
VALUE = re.compile(
    r"\s{0,3}(?:\"(?P<a>(?:\\.|[^\"\\\n])+)\"|'(?P<b>(?:\\.|[^'\\\n])+)')"
    r"|[^\S\n]{0,3}[\"'`]?(?P<c>(?:(?![&,;#][\"']?\w[\w.-]{0,64}[\"']?[=:])[^\s\"'`<>])+)"
)
#: Places of the features that tell whether a name of a secret, or a quote, stands before.
OF_NAME = (6, 7)
#: A key-like value: the least entropy in bits a character, and the most that words cover and digits are.
KEY_ENTROPY, KEY_WORDS, KEY_DIGITS = 3.0, 0.5, 0.9
FOUND = "doc_id BIGINT, start INT, end INT, value STRING, features ARRAY<DOUBLE>, assigned BOOLEAN"


def _class(c: str) -> str:
    return "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c


def covered(value: str, words: frozenset) -> float:
    """Share of the letters and digits that words of the dictionary cover, longest first at each place."""
    low, at, out = value.lower(), 0, 0
    while at < len(low):
        n = next((n for n in range(min(LONG, len(low) - at), SHORT - 1, -1) if low[at:at + n] in words), 0)
        out += n
        at += n or 1
    return out / max(len(low), 1)


def features(text: str, start: int, end: int, path: str, words: frozenset) -> list[float]:
    value = text[start:end]
    n, classes = len(value), [_class(c) for c in value]
    counts = np.unique(list(value), return_counts=True)[1] / n
    before = re.findall(r"[^\W_]+", text[max(0, start - NEAR):start].lower())
    after = re.findall(r"[^\W_]+", text[end:end + NEAR].lower())
    near = np.zeros(2 * PLACES)
    for word in before[-2:]:
        if word in NAMES:
            continue
        near[zlib.crc32(word.encode()) % PLACES] = 1
    for word in after[:1]:
        near[PLACES + zlib.crc32(word.encode()) % PLACES] = 1
    return [
        math.log2(n), sum(a != b for a, b in zip(classes, classes[1:])) / n, covered(value, words),
        float(-(counts * np.log2(counts)).sum()), sum(map(str.isdigit, value)) / n, sum(map(str.isupper, value)) / n,
        float(any(w in NAMES for w in before[-2:])), float(text[max(0, start - 1):start] in ("'", '"')),
        float(zlib.crc32((path or "").encode()) % PLACES), *near,
    ]


def places(text: str) -> dict[tuple[int, int], bool]:
    """Where candidates start and end, in order, and whether a name of a secret is assigned each."""
    out = {}
    for name in SIGNED.finditer(text):
        m = NAMED.search(name[1]) and VALUE.match(text, name.end())
        if m:
            start = m.start(m.lastgroup)
            length = len(m[m.lastgroup] if m.lastgroup != "c" else m["c"].rstrip(".,;:!?)]}"))
            if length:
                out[start, start + length] = True
    starts = {start for start, _ in out}
    for m in CANDIDATE.finditer(text):
        out[m.span()] = m.start() in starts or bool(ASSIGNED.search(text, max(0, m.start() - NEAR), m.start()))
    return dict(sorted(out.items()))


def candidates(docs: DataFrame, words: frozenset) -> DataFrame:
    """Every candidate: `doc_id`, `start`, `end`, `value`, `features` and whether a name of a secret
    is assigned it."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def each(batch):
        out: dict = {c: [] for c in ("doc_id", "start", "end", "value", "features", "assigned")}
        for doc, text, path in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "path"))):
            for (start, end), assigned in places(text or "").items():
                row = (doc, start, end, text[start:end], features(text, start, end, path, shared.value), assigned)
                for c, v in zip(out, row):
                    out[c].append(v)
        return out

    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", path.alias("path")), each, FOUND)


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def dictionary(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """`w`: the words in at least `share` of all documents, and in two, with and without accents."""
    least = max(2, math.ceil(share * docs.count()))
    low = F.regexp_replace(F.lower("text"), r"\p{M}+", "")
    found = F.regexp_extract_all(low, F.lit(rf"(?<!\p{{L}})\p{{L}}{{{SHORT},{LONG}}}(?!\p{{L}})"), F.lit(0))
    words = docs.select(F.explode(F.array_distinct(found)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def each(batch):
        return {"w": [x for w in batch["w"].to_pylist() for x in {w, _plain(w)}]}

    return mapped(words.where(F.col("n") >= least).select("w"), each, "w STRING").distinct()


def with_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """`found` with the dictionary's coverage, by a join of the values' parts with the words."""

    def parts(batch):
        out: dict = {"value": [], "w": []}
        for value in batch["value"].to_pylist():
            runs = re.findall(r"[^\W\d_]+", value.lower())
            some = {r[i:i + n] for r in runs for i in range(len(r)) for n in range(SHORT, min(LONG, len(r) - i) + 1)}
            out["value"] += [value] * len(some)
            out["w"] += some
        return out

    def each(batch):
        values = batch["value"].to_pylist()
        return {"value": values, "coverage": [covered(v, frozenset(w or ())) for v, w in zip(values, batch["words"].to_pylist())]}

    values = found.select("value").distinct()
    hits = mapped(values, parts, "value STRING, w STRING").join(words, "w", "left_semi").groupBy("value").agg(F.collect_set("w").alias("words"))
    coverage = mapped(values.join(hits, "value", "left"), each, "value STRING, coverage DOUBLE")
    own = F.concat(F.slice("features", 1, 2), F.array("coverage"), F.slice("features", 4, 1000))
    return found.join(coverage, "value").withColumn("features", own).select(*found.columns)


def described(docs: DataFrame) -> DataFrame:
    """The candidates with the coverage by the dictionary of all documents, broadcast if it is small."""
    words = written(dictionary(docs), "words")
    if words.count() <= limit_of(docs.sparkSession, "broadcastRows"):
        return written(candidates(docs, frozenset(r.w for r in words.collect())), "candidates")
    return written(with_coverage(written(candidates(docs, frozenset()), "places"), words), "candidates")


def seeds(found: DataFrame) -> DataFrame:
    """Findings labelled by what they are sure to be: `label` 1 where a name of a secret is assigned one, 0
    where it stands bare and does not look like a key. Bare values that do are left out."""
    value = lambda i: F.get("features", F.lit(i))
    key = (value(3) >= KEY_ENTROPY) & (value(2) < KEY_WORDS) & (value(4) <= KEY_DIGITS)
    return found.where(F.col("assigned") | ~key).select("doc_id", "start", "end", F.col("assigned").cast("int").alias("label"))


def scan(docs: DataFrame, findings: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """Every candidate with the forest's `score` and `secret` (score of at least a half).

    `findings` are labelled (`doc_id`, `start`, `end`, `label`: 1 secret, 0 not); without them `seeds`
    label them, and the features that they are labelled by are left out. At most `sample` are learnt from. Null and empty texts have no candidates; rows with a
    null or repeated `doc_id` are each scanned; other columns are ignored; an empty table gives no row.
    If the findings are all of one label, so is every candidate; without any, none is a secret.
    """
    found = described(docs)
    labels = (seeds(found) if findings is None else findings).where("label IS NOT NULL").dropDuplicates(["doc_id", "start", "end"])
    some = bounded_sample(labels.select("doc_id", "start", "end", F.col("label").cast("double").alias("label")), sample, "doc_id", "start", "end")
    seen = F.filter("features", lambda x, i: ~i.isin(*OF_NAME)) if findings is None else F.col("features")
    rows = found.join(F.broadcast(some), ["doc_id", "start", "end"]).select("label", array_to_vector(seen).alias("x"))
    rows = written(rows, "findings")
    kinds = [r.label for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        return found.select("doc_id", "start", "end", "value", F.lit(float(kinds[0]) if kinds else 0.0).alias("score")).withColumn("secret", F.col("score") >= 0.5)
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt"
    ).fit(rows)
    scored = forest.transform(found.withColumn("x", array_to_vector(seen)))
    return scored.select("doc_id", "start", "end", "value", vector_to_array("probability")[1].alias("score")).withColumn("secret", F.col("score") >= 0.5)


def op2_secrets(spark, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"))
    return found.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "secret")
