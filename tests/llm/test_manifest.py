import hashlib
import random
import re
import zlib

import pytest

from checks.compare import compare
from conftest import FOLDER
from fleetpulse.llm import manifest as op

TYPES = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, leaf STRING, root STRING, at STRING"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The root, and for each node its siblings by level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = nodes[at // 16 * 16:at // 16 * 16 + 16]
            paths[i].append((run[:at % 16], run[at % 16 + 1:]))
            where[i] = at // 16
        nodes = [sha("".join(nodes[k:k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(docs):
    trees = {}
    for d in docs:
        trees.setdefault(d[3], []).append((d[0] is not None, d[0] or 0, leaf(*d), d))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    ups = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in names}
    root, above = climb([ups[s][0] for s in names])
    out = []
    for s, more in zip(names, above):
        for (*_, own, d), path in zip(sorted(trees[s], key=lambda x: x[:3]), ups[s][1]):
            steps, node = path + more, own
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[1] is not None:
                node = leaf(d[0], re.sub("[A-Z]", lambda m: m[0].lower(), d[1]), *d[2:])
            for left, right in steps:
                node = sha("".join(left + [node] + right))
            proof = sha("".join("".join(left + right) for left, right in steps))
            out.append((str(d[0]), own, ups[s][0], root, proof, node, node == root))
    return sorted(out)


def found(spark, docs, monkeypatch):
    df = spark.createDataFrame([(*d, "x", "y", None) for d in docs], TYPES).repartition(5)
    monkeypatch.setattr(op, "table", lambda *_: df)
    return sorted((str(r[0]), *r[1:]) for r in op.op12_manifest(spark, "").collect())


def made(sizes, seed=1):
    rng = random.Random(seed)
    docs = []
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "Ab CD é", "x" * rng.randrange(40), "Title Case"])
            docs.append((rng.choice([None, *range(-5, 4 * n)]), text, rng.choice([None, "en", "fr"]), source, rng.choice([None, 7])))
    return docs + docs[:3]


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 16}, {"a": 17, None: 1}, {"a": 256, "b": 257, "": 5, None: 30}, {f"s{i}": 1 + i % 4 for i in range(300)}, {"é": 4200, "z": 3},
], ids=str)
def test_brute_force(spark, monkeypatch, sizes):
    docs = made(sizes)
    assert found(spark, docs, monkeypatch) == brute(docs)


def test_repeated_rows_are_leaves_each(spark, monkeypatch):
    docs = [(5, "Same", "en", "hot", 4)] * 600 + [(5, "other", None, "hot", None)] * 2
    assert found(spark, docs, monkeypatch) == brute(docs)


def test_empty_table_and_long_text(spark, monkeypatch):
    assert found(spark, [], monkeypatch) == []
    docs = [(i, "Long É " * 200_000, "en", "a", 1) for i in range(3)]
    assert found(spark, docs, monkeypatch) == brute(docs)


def test_a_change_of_any_kind_is_found(spark):
    docs = spark.createDataFrame([(*d, "x", "y", None) for d in made({"a": 40, "b": 3})], TYPES)
    rows = op.manifest(docs).select("root", op.fold(op.F.lit("0" * 64), op.F.col("path")).alias("forged")).collect()
    assert all(r.root != r.forged for r in rows) and len({r.root for r in rows}) == 1


def test_query(spark, con):
    rows = op.op12_manifest(spark, FOLDER)
    assert compare(rows, con, op.SQL) is None
    assert {r.verified for r in rows.select("verified").distinct().collect()} == {True, False}
