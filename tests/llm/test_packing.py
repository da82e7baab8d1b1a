import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from conftest import FOLDER
from fleetpulse.llm import packing as op
from fleetpulse.llm.tables import table
from fleetpulse.llm.tokens import public_path
from llm.conftest import ODD


def ids_of(texts):
    plain = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    return [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def padding(totals):
    return sum(0 if n & (n - 1) == 0 else 2048 - n for n in totals.values()) / max(1, sum(totals.values()))


def check_layout(rows):
    """Gapless sequences of at most 2048; returns their totals."""
    at = {}
    for seq, offset, length in sorted(rows):
        assert length > 0 and offset == at.get(seq, 0)
        at[seq] = offset + length
    assert all(n <= 2048 for n in at.values())
    return at


@pytest.mark.parametrize("kind", ["spread", "one length", "short", "few", "long", "none", "mixed"])
def test_plan_places_every_piece_once(kind):
    rng = random.Random(kind)
    lengths = {
        "spread": [rng.randint(1, 2047) for _ in range(30000)], "one length": [1500] * 5000, "short": [rng.randint(1, 4) for _ in range(5000)],
        "few": [rng.randint(1, 2048) for _ in range(7)], "long": [rng.randint(1100, 2047) for _ in range(4000)], "none": [],
        "mixed": [1500] * 4000 + [35] * 3000 + [2048] * 50 + [rng.randint(1, 2047) for _ in range(500)],
    }[kind]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    covered, rows = {}, []
    for length, lo, hi, used, size, per, first, offset in op.plan(histogram):
        for r in range(lo, hi):
            covered.setdefault((length, r), []).append((used, size))
            rows.append((first + (r - lo) // per, offset + (r - lo) % per * size, size))
    assert set(covered) == {(n, r) for n, c in histogram.items() for r in range(c)}
    for (length, _), parts in covered.items():
        at = 0
        for used, size in sorted(parts):
            assert used == at and (used % op.BLOCK == 0)
            at += size
        assert at == length
    totals = check_layout(rows)
    # At most the last window, and under a block in others.
    assert padding(totals) * max(1, sum(totals.values())) <= 2048 + 0.03 * sum(totals.values())
    if kind == "spread":
        assert padding(totals) < 0.003
        assert sum(len(p) > 1 for p in covered.values()) < 0.05 * len(covered)


def test_counts_solve_the_least_squares_problem():
    rng = np.random.default_rng(1)
    lengths = sorted({int(x) for x in rng.integers(1, 100, 30)} | {50})
    combos = op.combinations_of(lengths, 100)
    a = np.array([[c.count(n) for c in combos] for n in lengths], float)
    true = np.maximum(rng.normal(2, 4, len(combos)), 0)
    n = a @ true
    x = np.array(op.repeat_counts(combos, dict(zip(lengths, n)), 20000))
    gradient = a.T @ (a @ x - n)
    assert (x >= 0).all() and np.abs(gradient[x > 1e-6]).max() < 1 and gradient.min() > -1 and np.abs(a @ x - n).max() < 1


def test_joined_crc():
    rng = random.Random(1)
    for _ in range(50):
        parts = [rng.randbytes(rng.choice([0, 1, 4, 77, 256])) for _ in range(rng.randint(0, 6))]
        assert op.joined_crc([zlib.crc32(p) for p in parts], list(map(len, parts))) == zlib.crc32(b"".join(parts))


def check_rows(found, docs):
    """Every id of every document in exactly one piece, whichever of equal rows it belongs to."""
    want, got = {}, {}
    for (doc, _), ids in zip(docs, ids_of([t for _, t in docs])):
        want.setdefault(doc, []).append(ids)
    for r in found:
        got.setdefault(r.doc_id, []).append(r)
    assert set(want) == set(got)
    for doc, texts in want.items():
        assert sum(r.length for r in got[doc]) == sum(map(len, texts))
        for r in got[doc]:
            fits = [t for t in texts if len(t) == r.doc_tokens and zlib.crc32(np.array(t[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
            assert fits
        if len(texts) == 1:
            at = 0
            for r in sorted(got[doc], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    return check_layout([(r.sequence_id, r.offset, r.length) for r in found])


def test_documents(spark, frame):
    docs = ODD + [(100 + i, "word " * n) for i, n in enumerate([1, 5000, 2047, 2048, 2046, 4095, 1500, 1500, 1500, 1499])]
    check_rows(op.pack(frame(docs), public_path("word_bpe_49k.json")).collect(), docs)
    assert op.pack(frame([]), public_path("word_bpe_49k.json")).count() == 0


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect()]
    totals = check_rows(op.op5_packing(spark, FOLDER).collect(), docs)
    assert padding(totals) < 0.03
