import hashlib
import random

import numpy as np
import pytest

from conftest import FOLDER
from fleetpulse.llm import substrings as op
from fleetpulse.llm.tables import table
from llm.conftest import ODD


def brute(docs, size=100):
    """Every string by value; documents in order, a null id last, one id's texts by their hash."""
    import xxhash

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    order = {(1 << 63 if i is None else i, signed(xxhash.xxh64_intdigest((t or "").encode(), seed=42)), t or "") for i, t in docs}
    seen, out = set(), {}
    for i, _, t in sorted(order):
        data = t.encode()
        gone, new = np.zeros(len(data), bool), []
        for k in range(len(data) - size + 1):
            w = data[k:k + size]
            if w in seen:
                gone[k:k + size] = True
            seen.add(w)
        spans = sum(bool(g) and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i, t] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted((str(i), *out[1 << 63 if i is None else i, t or ""]) for i, t in docs)


def rows_of(found):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)


def made(n=90):
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(60, 400))) for _ in range(8)]
    docs = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 200))) for _ in range(rng.randint(0, 6))]
        docs.append((rng.randint(0, 2 * n), "".join(parts)))
    docs += [(500 + i, docs[3][1]) for i in range(5)] + [(600, "ab" * 300), (601, "ab" * 40), (602, "The " * 200), (603, "x" * 99), (604, "x" * 100), (605, "x" * 101)]
    docs += [(None, docs[5][1]), (None, "null " * 60), (700, passages[0][:99] + "!"), (701, passages[0][:100])]
    return ODD + docs


@pytest.mark.parametrize("crowd,at_once,looked,seen", [
    (200_000, 60_000, 4_000, 10), (3, 60_000, 12, 10), (200_000, 10, 12, 1), (3, 10, 4_000, 2), (5, 7, 40, 2), (200_000, 60_000, 0, 10),
])
def test_brute_force(spark, frame, monkeypatch, crowd, at_once, looked, seen):
    """The sample sees all documents, some or next to none; crowds are known before or met in a bucket."""
    for name, value in (("LOOKED", looked or 1), ("SEEN", seen), ("BUCKET", 50), ("TAKEN", 100_000 if looked else 1)):
        monkeypatch.setattr(op, name, value)
    monkeypatch.setattr(op, "CROWD", crowd)
    monkeypatch.setattr(op, "AT_ONCE", at_once)
    monkeypatch.setattr(op, "_buckets", _with(crowd, at_once))
    docs = made()
    assert rows_of(op.deduplicate(frame(docs)).collect()) == brute(docs)


def _with(crowd, at_once):
    """The bucket step with limits of its own: a worker imports the module afresh."""

    def step(batches):
        from fleetpulse.llm import substrings

        substrings.CROWD, substrings.AT_ONCE = crowd, at_once
        try:
            yield from substrings.__dict__["_buckets"](batches)
        finally:
            substrings.CROWD, substrings.AT_ONCE = 200_000, 60_000

    return step


def test_batches_cut_anywhere_give_the_same_ranges():
    """Sorted suffixes in batches of any size, with settled rows and crowds among them."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    leads = sorted(rng.choice([b"%024d" % i for i in range(40)], 500).tolist() + [b"c" * 24] * 90)
    rows = [(int(rng.integers(9)), i, int(rng.integers(200, 999)), x, b"r" * 76, b"l" * 76, None, None, False) for i, x in enumerate(leads)]
    rows = [(7, 0, 0, None, None, None, 5, 105, False)] * 3 + rows
    names = ["uid", "ord", "pos", "lead", "rest", "back", "lo", "hi", "crowd"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    seen = set()
    for size in (1, 7, 64, 1000):
        for at_once in (5, 100, 60_000):
            op.CROWD, op.AT_ONCE, kept = 50, at_once, (op.CROWD, op.AT_ONCE)
            try:
                got = [r for b in op._buckets(batch.slice(k, size) for k in range(0, len(rows), size)) for r in b.to_pylist()]
            finally:
                op.CROWD, op.AT_ONCE = kept
            assert sum(r["lead"] == b"c" * 24 for r in got) == 90
            seen.add(tuple(sorted((r["uid"], r["pos"] or -1, r["lead"] or b"", r["lo"] or -1, r["hi"] or -1) for r in got)))
    assert len(seen) == 1


def test_kept_bytes(spark, frame):
    docs = made(30)
    for r in op.deduplicate(frame(docs), kept_bytes=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed


def test_every_string_has_an_anchor_and_equal_ones_the_same():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    data = np.concatenate([data, data[500:900], np.tile(data[:3], 200)])
    at, hashes = op.anchors(data)
    inside = set(at.tolist())
    by_string = {}
    for k in range(len(data) - 99):
        own = [a - k for a in range(k, k + op.LEFT + 1) if a in inside]
        assert own
        least = min(own, key=lambda o: (op.key_hashes(data[k:k + 100])[o], o))
        assert by_string.setdefault(data[k:k + 100].tobytes(), least) == least


def test_multikey_order():
    rng = np.random.default_rng(6)
    rows = rng.integers(0, 3, (400, 21)).astype(np.uint8)
    rows[100:200] = rows[:100]
    rows[:, :9][rng.random(400) < 0.7] = 1
    order, common = op.multikey_order(rows)
    as_bytes = [r.tobytes() for r in rows[order]]
    assert as_bytes == sorted(r.tobytes() for r in rows) and sorted(order) == list(range(400))
    for k in range(1, 400):
        n = next((i for i in range(21) if as_bytes[k][i] != as_bytes[k - 1][i]), 21)
        assert common[k] == n
    assert common[0] == 0


def test_empty_table(spark, frame):
    assert op.deduplicate(frame([])).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    found = rows_of(op.op4_substrings(spark, FOLDER).collect())
    assert found == brute(docs) and any(r[2] for r in found)
