import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row

from checks.compare import compare
from conftest import FOLDER
from fleetpulse.llm import divergence as op

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, least, top):
    words = [(lang or "", source or "", TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in docs]
    out = []
    for lang in {w[0] for w in words}:
        mine = [w for w in words if w[0] == lang]
        seen, total, of = Counter(), Counter(), defaultdict(Counter)
        for _, source, ws in mine:
            seen.update(set(ws))
            total.update(ws)
            of[source].update(ws)
        kept = {t for t, n in seen.items() if n >= least}
        sources = {s for _, s, _ in mine}

        def p(counts, t):
            return 1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept))

        for s in sources:
            pairs = [(-sum(abs(p(of[s], t) - p(of[o], t)) for t in kept), o.encode()) for o in sources - {s}]
            terms = [(p(total, t) - p(of[s], t), t.encode()) for t in kept if of[s][t] and p(of[s], t) > p(total, t)]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(rows)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def made(seed, n=120, sources=7, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{i:c}" if i % 3 else f"É{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(97, 97 + vocabulary)]
    docs = []
    for _ in range(n):
        s = min(rng.randrange(sources * 2), sources) % sources  # one source has half of the rows
        some = rng.choices(words[s:s + vocabulary // 2], k=rng.randrange(30))
        docs.append((rng.choice(["en", "fr", None, ""]), rng.choice([f"s{s}", None]) if s == 3 else f"s{s}", " ".join(some)))
    return docs + [("xx", "one", "word"), ("yy", "a", ""), ("yy", "b", None), (None, None, None)] + docs[:9]


@pytest.fixture
def documents(spark):
    return lambda docs: spark.createDataFrame(
        [(i, *d, "x", 1) for i, d in enumerate(docs)], "doc_id BIGINT, lang STRING, source STRING, text STRING, term STRING, value BIGINT"
    ).repartition(7)


@pytest.mark.parametrize("top, least, cells, block", [(5, 3, 10**6, 256), (50, 1, 40, 2), (1, 10, 100, 3)])
def test_brute_force(documents, monkeypatch, top, least, cells, block):
    monkeypatch.setattr(op, "CELLS", cells)
    monkeypatch.setattr(op, "BLOCK", block)
    docs = made(top)
    assert rows_of(op.divergence(documents(docs), least, top)) == brute(docs, least, top)


def test_no_more_is_held_than_allowed(documents, monkeypatch):
    docs = made(9)
    monkeypatch.setattr(op, "HELD", 10)
    assert rows_of(op.divergence(documents(docs), 3, 4)) == brute(docs, 3, 4)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_skyband_is_exact(spark, monkeypatch, k):
    monkeypatch.setattr(op, "ROWS", 16)
    rng = random.Random(k)
    terms = []
    for s in ("a", "b"):
        for i in range(400):
            n = rng.randrange(1, 40)
            terms.append(Row(lang="l", source=s, term=f"t{i * 7919 % 1000}x{i}".encode(), n=n, c=n + rng.randrange(60)))
    found = op.skyband(spark.createDataFrame(terms).repartition(5), k).collect()
    over = {(t.source, bytes(t.term)): sum(o.n >= t.n and o.c <= t.c and o.term < t.term for o in terms if o.source == t.source) for t in terms}
    want = {key for key, n in over.items() if n < k}
    assert {(r.source, bytes(r.term)) for r in found} == want and len(found) == len(want)


def test_shares_of_very_large_counts(spark):
    n, total, terms = 9 * 10**12, 10**15 + 7, 12345
    row = spark.createDataFrame([(n, total, terms)], "n BIGINT, t BIGINT, v BIGINT").select(op.share(*map(op.F.col, "ntv"))).first()
    assert row[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_survivors_look_at_all_held():
    held = (np.zeros(3 * 8 * op.ROWS, np.int64), [b"a%06d" % i for i in range(3 * 8 * op.ROWS)])
    assert op.survivors(held, np.array([0]), [b"b"], 3 * 8 * op.ROWS + 1).tolist() == [True]
    assert op.survivors(held, np.array([0]), [b"b"], 3 * 8 * op.ROWS).tolist() == [False]


def test_odd_rows(documents, spark):
    assert rows_of(op.divergence(documents([]))) == []
    docs = [("en", "a", None), ("en", "b", " 12 !?"), ("en", "b", "x" * 1_500_000), ("en", "b", "x" * 1_500_000), (None, None, "")]
    assert rows_of(op.divergence(documents(docs), 2)) == brute(docs, 2, op.TOP)


def test_query(spark, con):
    assert compare(op.op11_divergence(spark, FOLDER), con, op.SQL) is None
