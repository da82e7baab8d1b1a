import random

import numpy as np
import pytest
import xxhash

from conftest import FOLDER
from fleetpulse.llm import simhash as op
from fleetpulse.llm.components import components
from fleetpulse.llm.tables import table
from llm.conftest import ODD


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ")
             .replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 4, 0) + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    group = list(range(len(fps)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((top(i), top(j)))
                group[b] = a
    return [top(i) for i in range(len(fps))]


def named(ids, tops):
    least = {}
    for i, t in zip(ids, tops):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    return [least.get(t) for t in tops]


def test_documents(spark, frame):
    docs = ODD + [(30 + i, "the quick brown fox jumps over the lazy dog " * 20 + "x" * (i % 3)) for i in range(9)]
    fps = [slow_fingerprint(t) for _, t in docs]
    want = sorted((str(i), f, str(c)) for (i, _), f, c in zip(docs, fps, named([i for i, _ in docs], slow_components(fps))))
    found = op.near_duplicates(frame(docs)).collect()
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in found) == want
    assert op.near_duplicates(frame([])).count() == 0


def clustered(n, rng):
    """Random fingerprints, and balls and chains around some."""
    fps = {0, (1 << 64) - 1, 0b1111, 0b11110000}
    while len(fps) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 1, 40])):
            fps.add(x)
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            x = y if rng.random() < 0.5 else x
            fps.add(y)
    return sorted(fps)


@pytest.mark.parametrize("cell,least", [(20_000, 14), (6, 14), (2, 3)])
def test_links_join_all_that_are_linked(spark, monkeypatch, cell, least):
    rng = random.Random(cell)
    fps = clustered(1200, rng)
    monkeypatch.setattr(op, "CELL", cell)
    monkeypatch.setattr(op, "LEAST_FREE", least)
    rows = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp BIGINT")
    links = {frozenset((r.u % (1 << 64), r.v % (1 << 64))) for r in op.near_links(rows).collect()}
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    at = {x: i for i, x in enumerate(fps)}
    group = list(range(len(fps)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in links:
        i, j = sorted((top(at[a]), top(at[b])))
        group[j] = i
    assert [top(i) for i in range(len(fps))] == slow_components(fps)


def test_pivots_never_discard_a_link():
    rng = random.Random(5)
    fps = np.array(clustered(400, rng), dtype=np.uint64)
    rows = op.distances(fps)
    for i in range(len(fps)):
        want = [j for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= 4]
        assert op._near(fps, rows, fps[i], rows[i]).tolist() == want


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u BIGINT, v BIGINT")).collect()}
    want = {}
    for _ in range(300):
        for u, v in pairs:
            if u is not None and v is not None and u != v:
                want[u] = want[v] = min(want.get(u, u), want.get(v, v))
    assert found == want
    assert components(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    fps = [slow_fingerprint(t) for _, t in docs]
    want = {(i, f"{f:016x}", c) for (i, _), f, c in zip(docs, fps, named([i for i, _ in docs], slow_components(fps)))}
    found = op.op7_simhash(spark, FOLDER).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == want and len(found) == len(docs)
