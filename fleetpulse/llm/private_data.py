"""Personal data by weak supervision, in DataFrame functions only.

Base spans are what a kind's pattern matches and its check accepts. Beyond them, looser patterns give
candidates, and three labelers vote on each (1 for, -1 against, 0 none): the *pattern* with its check,
a *gazetteer* (top-level domains, issuer digits, reserved networks, dialling prefixes), and the
*context*, words just before. Expectation-maximisation estimates from the counts of vote patterns how
reliable each labeler is for a kind and how likely each pattern is personal data; these likelihoods
train a logistic span classifier on votes and shape. Candidates it accepts that overlap no base span
are added.

Only counts of vote patterns (at most `KINDS` x 27 x 3 rows, whatever the size of the table) reach
the driver. Positions are code points, ends exclusive.
"""

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.tables import hex_digest, table, texts

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: Fixed patterns of the base; possessive quantifiers and starts only where a run begins keep them linear.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have before its kind's patterns are tried.
HAS = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]",
}
LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|\[\.\])[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.-])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[\x20.-]\(?[0-9]{2,4}\)?){2,4}+(?![0-9A-Za-z])",
}
LOOSE_HAS = {
    "email": r"@|[(\[]at[)\]]", "ip": r"[0-9](?:\.|\[\.\])[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"[0-9]\)?[\x20.-]\(?[0-9]{2,4}\)?[\x20.-]\(?[0-9]{2}",
}
DOMAINS = "com org net edu gov info io de fr es it uk eu us ca ch at nl be".split()
NEAR = 30
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b", "ip": r"(?i)\b(?:ip|host|server|address|login|from)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|karte|carte|tarjeta)\b", "phone": r"(?i)\b(?:phone|tel|call|fax|mobile|telefon)\b",
}
AGAINST = r"(?i)\b(?:version|section|chapter|isbn|token|order|build|page|no)\b"
LABELERS = ("pattern", "gazetteer", "context")
ROUNDS, BELIEF, BELIEVED = 300, 20, (0.9, 0.6, 0.5)
#: No match of any pattern is shorter.
SHORTEST = 3
MATCH = "struct<start:int,end:int,found:string,before:string>"


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once for a row, however often `then` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _before(values: Column, zero: Column, put) -> Column:
    """For each of an array of numbers, `put` of all before it, from `zero` on.

    Runs of about the root of the length are put together first, so that the work is the length times its root."""
    total = lambda part: F.aggregate(part, zero, put)

    def over_runs(runs):
        totals = F.transform(runs, total)
        first = _let(totals, lambda t: F.transform(t, lambda _, r: total(F.slice(t, F.lit(1), r))))
        inside = lambda start: lambda run, r: F.transform(run, lambda _, i: put(F.get(start, r), total(F.slice(run, F.lit(1), i))))
        return _let(first, lambda f: F.flatten(F.transform(runs, inside(f))))

    def whole(x):
        width = F.ceil(F.sqrt(F.size(x))).cast("int")
        starts = lambda w: F.sequence(F.lit(0), F.floor((F.size(x) - 1) / w).cast("int"))
        runs = _let(width, lambda w: F.transform(starts(w), lambda r: F.slice(x, r * w + 1, w)))
        return _let(runs, over_runs)

    return _let(values, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(F.array().cast("array<int>")))


def _of(name: str):
    return lambda x: x[name]


def _add(a: Column, b: Column) -> Column:
    return a + b


def _matches(text: Column, pattern: str, has: str) -> Column:
    """Leftmost non-overlapping matches as an array of (start, end, found, before); `before` is what stands
    just before, up to `NEAR` characters: at most of `NEAR` div `SHORTEST` matches and the text between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    last = lambda c: F.right(c, F.lit(NEAR))

    def pair(m, g):
        near = last(F.concat(last(g), m))
        return F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("found"), last(g).alias("led"), near.alias("near"))

    def placed(p):
        first = lambda i: F.greatest(i - NEAR // SHORTEST, F.lit(0))
        near = lambda i: F.array_join(F.transform(F.slice(p, first(i) + 1, i - first(i)), lambda q: q["near"]), "")

        def match(at):
            return lambda m, i: F.struct(
                (F.get(at, i) + m["gap"]).cast("int").alias("start"), (F.get(at, i) + m["gap"] + m["size"]).cast("int").alias("end"),
                m["found"].alias("found"), last(F.concat(near(i), m["led"])).alias("before"),
            )

        lengths = F.transform(p, lambda m: m["gap"] + m["size"])
        return _let(_before(lengths, F.lit(0), _add), lambda at: F.transform(p, match(at)))

    pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), pair)
    return F.when(text.rlike(has), _let(pairs, placed)).otherwise(F.array().cast(f"array<{MATCH}>"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _small_parts(c: Column) -> Column:
    """No part of a dotted number above 255, however many zeros lead it."""
    plain = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(c, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.substring(plain(p), 1, 3).try_cast("int") <= 255))


def _luhn(c: Column) -> Column:
    each = F.split(F.reverse(_digits(c)), "(?!^)(?!$)")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    value = F.transform(each, lambda d, i: F.when(i % 2 == 1, twice(d.try_cast("int"))).otherwise(d.try_cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, c: Column) -> Column:
    if kind == "ip":
        return _small_parts(c)
    if kind == "card":
        return F.length(_digits(c)).between(16, 19) & _luhn(c)
    if kind == "phone":
        return F.length(_digits(c)).between(8, 15)
    return F.lit(True)


def _base(text: Column, kind: str) -> Column:
    return F.filter(_matches(text, BASE[kind], HAS[kind]), lambda m: _valid(kind, m["found"]))


def _gazetteer(kind: str, c: Column) -> Column:
    if kind == "email":
        last = F.lower(F.regexp_extract(c, r"([A-Za-z0-9-]+)$", 1))
        return F.when(last.isin(DOMAINS), 1).otherwise(-1)
    if kind == "ip":
        first = F.regexp_extract(c, "^([0-9]{1,3})", 1).try_cast("int")
        return F.when((first == 0) | (first >= 240), -1).when(first.isin(10, 127), 0).otherwise(1)
    if kind == "card":
        return F.when(F.substring(c, 1, 1).isin("2", "3", "4", "5", "6"), 1).otherwise(-1)
    return F.when(c.rlike(r"^(?:\+|00)[1-9]"), 1).otherwise(0)


def _loose(matches: Column, kind: str) -> Column:
    """Candidates of a kind with votes and shape (0 plain, 1 with separators, 2 written around)."""

    def judge(m):
        c, before = m["found"], m["before"]
        fits = c.rlike(f"^(?:{BASE[kind].replace(chr(92) + 'G|', '')})$") & _valid(kind, c)
        votes = {
            "pattern": F.when(fits, 1).otherwise(-1),
            "gazetteer": _gazetteer(kind, c),
            "context": F.when(before.rlike(CONTEXT[kind]), 1).when(before.rlike(AGAINST), -1).otherwise(0),
        }
        shape = F.when(c.rlike(r"[(\[](?:at|dot|\.)[)\]]"), 2).when(c.rlike(r"[\x20()]"), 1).otherwise(0)
        return F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
            *[v.cast("int").alias(n) for n, v in votes.items()], shape.alias("shape"),
        )

    return F.transform(matches, judge)


def _spans_of(text: Column) -> Column:
    """Base spans (kind, start, end) of all kinds."""
    def named(kind):
        return lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))

    return F.concat(*[F.transform(_base(text, k), named(k)) for k in KINDS])


def _event(pos: Column, turn: int, starts: int, ends: int, at: Column) -> Column:
    parts = {"pos": pos, "turn": F.lit(turn), "starts": F.lit(starts), "ends": F.lit(ends), "at": at}
    return F.struct(*[v.cast("int").alias(n) for n, v in parts.items()])


def _marked(rows: DataFrame) -> DataFrame:
    """`rows` with `taken` in their candidates `loose`: whether they overlap a base span of any kind.

    That is so if more base spans start before a candidate's end than end by its start. Both are counted
    in one order of all starts and ends: at one place ends come first, and then starts. Each step is a
    column of its own, so that none is computed again for each element of another."""
    names, nobody = rows.columns, F.lit(-1)
    rows = rows.withColumn("_events", F.when((F.size("base") > 0) & (F.size("loose") > 0), F.array_sort(F.concat(
        F.transform("base", lambda b: _event(b["start"], 1, 1, 0, nobody)), F.transform("base", lambda b: _event(b["end"], 0, 0, 1, nobody)),
        F.transform("loose", lambda c, i: _event(c["start"], 1, 0, 0, 2 * i)), F.transform("loose", lambda c, i: _event(c["end"], 0, 0, 0, 2 * i + 1)),
    ))))
    counts = {f"_{f}": _before(F.transform("_events", _of(f)), F.lit(0), _add) for f in ("starts", "ends")}
    rows = rows.select("*", *[v.alias(n) for n, v in counts.items()])
    # Zipped, not looked up from inside: a column that a lambda refers to may be put there whole.
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    told = F.zip_with(F.zip_with("_events", "_starts", pair), "_ends", lambda x, ends: F.struct(
        x["a"]["at"].alias("at"), F.when(x["a"]["at"] % 2 == 0, ends).otherwise(x["b"]).alias("n")))
    rows = rows.withColumn("_told", F.array_sort(F.filter(told, lambda x: x["at"] >= 0)))
    side = lambda odd: F.filter("_told", lambda x: x["at"] % 2 == odd)
    taken = F.zip_with(side(1), side(0), lambda starts, ends: starts["n"] > ends["n"])
    taken = F.coalesce(taken, F.transform("loose", lambda c: F.lit(False)))
    mark = lambda c, t: F.struct(*[c[f].alias(f) for f in ("kind", "start", "end", *LABELERS, "shape")], t.alias("taken"))
    return rows.withColumn("loose", F.zip_with("loose", taken, mark)).select(*names)


def _judged(docs: DataFrame) -> DataFrame:
    """`docs` with the base spans of a text and its candidates, as `base` and `loose`."""
    return _marked(_candidates(docs, _spans_of(F.col("text")).alias("base")))


def _candidates(docs: DataFrame, *more: Column) -> DataFrame:
    """`docs` with `more` columns and the candidates of all kinds, as `loose`."""
    found = [_matches(F.col("text"), LOOSE[k], LOOSE_HAS[k]).alias(f"_{k}") for k in KINDS]
    rows = docs.select("*", *more, *found)
    loose = F.concat(*[_loose(F.col(f"_{k}"), k) for k in KINDS])
    return rows.select(*[c for c in rows.columns if c not in {f"_{k}" for k in KINDS}], loose.alias("loose"))


def reliabilities(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation for one kind, from vote patterns and their counts.

    The share of true candidates, for each labeler the chances of votes (-1, 0, 1) given false and
    true, and the likelihood of each pattern. `BELIEF` made-up votes for each labeler, most of them
    right, keep true and false from changing places and decide where there are few candidates."""
    votes = np.array([p for p, _ in patterns]) + 1
    counts = np.array([n for _, n in patterns], float)
    belief = np.array([[[r, 0.95 - r, 0.05], [0.05, 0.95 - r, r]] for r in BELIEVED[:votes.shape[1]]])
    chances, share = belief, 0.5
    for _ in range(ROUNDS):
        logs = np.array([[sum(log(chances[j, t, v]) for j, v in enumerate(row)) for t in (0, 1)] for row in votes])
        logs += np.log([1 - share, share])
        true = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        share = float(np.clip((counts @ true + 1) / (counts.sum() + 2), 0.01, 0.99))
        seen = np.array([[np.bincount(v, counts * w, 3) for w in (1 - true, true)] for v in votes.T]) + BELIEF * belief
        chances = seen / seen.sum(axis=2, keepdims=True)
    return share, chances, true


def _features(votes: tuple[int, ...], shape: int) -> list[float]:
    return [1.0, *[float(v == x) for v in votes for x in (-1, 1)], float(shape == 1), float(shape == 2)]


def classifier(rows: list[tuple[tuple[int, ...], int, int]], rounds: int = 400, rate: float = 1.0) -> list[float]:
    """Weights of the span classifier of one kind from (votes, shape, count), by gradient steps on the
    logistic loss against the likelihoods of expectation-maximisation."""
    merged: dict = {}
    for votes, _, n in rows:
        merged[votes] = merged.get(votes, 0) + n
    likely = dict(zip(merged, reliabilities(list(merged.items()))[2]))
    x = np.array([_features(v, s) for v, s, _ in rows])
    y = np.array([likely[v] for v, _, _ in rows])
    share = np.sqrt(np.array([n for *_, n in rows], float))  # so that rare patterns count
    share /= share.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        w -= rate * (x.T @ (share * (1 / (1 + np.exp(-x @ w)) - y)) + 1e-4 * w)
    return w.tolist()


def train(docs: DataFrame) -> dict[str, list[float]]:
    """The weights of each kind that has candidates, from the counts of vote patterns of all documents."""
    # Outer, as else a filter on the size of the array is added, which finds all candidates twice.
    votes = _candidates(docs.select("text")).select(F.explode_outer("loose").alias("c")).where("c IS NOT NULL").select("c.*")
    counts = votes.groupBy("kind", *LABELERS, "shape").agg(F.count("*").alias("n")).collect()
    out = {}
    for kind in KINDS:
        rows = sorted((tuple(r[x] for x in LABELERS), r["shape"], r["n"]) for r in counts if r["kind"] == kind)
        if rows:
            out[kind] = classifier(rows)
    return out


def _accepts(weights: dict[str, list[float]], c: Column) -> Column:
    def score(kind):
        if kind not in weights:
            return F.lit(False)
        w = weights[kind]
        total, at = F.lit(w[0]), 1
        for name in LABELERS:
            for x in (-1, 1):
                total, at = total + F.when(c[name] == x, w[at]).otherwise(0.0), at + 1
        for s in (1, 2):
            total, at = total + F.when(c["shape"] == s, w[at]).otherwise(0.0), at + 1
        return total >= 0

    out = F.lit(False)
    for kind in KINDS:
        out = F.when(c["kind"] == kind, score(kind)).otherwise(out)
    return out


def find_spans(docs: DataFrame, weights: dict[str, list[float]]) -> DataFrame:
    """Adds `base` and `spans`, arrays of (kind, start, end) in the order of kinds, then starts."""
    new = F.filter("loose", lambda c: ~c["taken"] & _accepts(weights, c))
    added = F.transform(new, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    rows = _judged(docs).withColumn("_every", F.concat("base", added))
    by_start = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    of = lambda kind: F.array_sort(F.transform(F.filter("_every", lambda s: s["kind"] == kind), by_start))
    ordered = F.concat(*[of(k) for k in KINDS])
    spans = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select(*docs.columns, "base", spans.alias("spans"))


def private_data(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text` (null: empty), `base` and `spans` of every document.

    Empty texts have no spans. Rows with a null or repeated `doc_id` are each searched; other columns
    are ignored; an empty table gives no row. Without candidates the base stays alone.
    """
    rows = texts(docs)
    return find_spans(rows, train(rows))


def redacted(text: Column, spans: Column) -> Column:
    """The text with the name of the kind in place of each span; of spans that overlap, the one that
    begins first stands for all, or the longest of them."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))

    def pieces(o):
        def piece(at):
            def one(s, i):
                start = F.get(at, i)
                words = F.concat(F.substring(text, start + 1, s["start"] - start), F.lit("["), F.upper(s["kind"]), F.lit("]"))
                return F.when(s["start"] < start, "").otherwise(words)

            return one

        ends = F.transform(o, lambda s: -s["less"])
        rest = F.substring(text, F.array_max(ends) + 1, F.length(text))
        done = _let(_before(ends, F.lit(0), lambda a, b: F.greatest(a, b)), lambda at: F.transform(o, piece(at)))
        return F.concat(F.array_join(done, ""), rest)

    return F.when(F.size(spans) > 0, _let(order, pieces)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with their spans redacted, and `n_chars`, if there is such a column, counted
    anew. All other columns stay; a null text stays null."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = find_spans(rows, train(rows.select("text")))
    text = F.when(F.col("row.text").isNotNull(), redacted(F.col("text"), F.col("spans")))
    found = found.select("row", text.alias("new"))
    put = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in put:
        put["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new")).otherwise(put["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*[v.alias(c) for c, v in put.items()])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_private_data(spark, folder: str) -> DataFrame:
    found = private_data(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS), hex_digest(_written(F.col("base"))).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )
