import hashlib
import pickle
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from checks.compare import compare
from conftest import FOLDER
from fleetpulse.llm import decontamination as op
from fleetpulse.llm.tables import table
from llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=13):
    out = []
    for doc, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            iw = words(t)
            for i in range(max(len(iw) - size, 0) + 1) if iw else ():
                p = iw[i:i + size]
                for k in range(len(w) - len(p) + 1):
                    if w[k:k + len(p)] == p:
                        hit.update(range(k, k + len(p)))
                        ids.add(item)
        out.append((str(doc), len(w), len(hit), sorted(ids)))
    return sorted(out)


ITEMS = [(1, "alpha beta gamma"), (2, "Same TEXT here"), (3, None), (4, "..."), (2, "Same TEXT here"), (10, "a b a b a b a b a b a b a b a b"), (11, "one")]
DOCS = ODD + [(20, "x Alpha-Beta, gamma! alpha beta gamma"), (21, "a b " * 12), (22, "alpha beta"), (23, "ónes one ÓNE"), (24, "one one")]


@pytest.mark.parametrize("block,rows", [(10**6, 10**6), (8, 10**6), (20, 0)])
def test_brute_force(spark, frame, monkeypatch, limits, block, rows):
    monkeypatch.setattr(op, "BLOCK_WORDS", block)
    limits(broadcastRows=rows)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id BIGINT, text STRING, doc_id STRING")
    found = op.contamination(frame(DOCS), items).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in found) == brute(DOCS, ITEMS)
    spans = {r.doc_id: r.spans for r in found}
    assert [(s.start, s.end) for s in spans[20]] == [(2, len(DOCS[-5][1]))]
    assert [DOCS[-2][1][s.start:s.end] for s in spans[23]] == ["one"]


def test_long_items_in_pieces(spark, frame, monkeypatch):
    """An item of several pieces, and texts that repeat any part of it, whatever the border."""
    monkeypatch.setattr(op, "PIECE", 30)
    monkeypatch.setattr(op, "BLOCK_WORDS", 70)
    item = [f"w{i}" for i in range(200)]
    items = [(1, " ".join(item)), (2, " ".join(item[50:70])), (3, " ".join(item[150:]))]
    docs = [(i, " ".join(["x", *item[i:i + 13 + i % 7], "y"])) for i in range(190)] + [(500, " ".join(item)), (501, " ".join(item[:12]))]
    docs += [(600 + i, docs[40][1]) for i in range(5)]
    found = op.contamination(frame(docs), spark.createDataFrame(items, "item_id BIGINT, text STRING")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"])) for r in found) == brute(docs, items)


def test_memory_of_many_items(spark):
    """20 MB of items: every block is within its bound, all words are there, and one automaton stays small."""
    count = 3000
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.substring(F.sha2(F.concat("id", F.lit("-"), i).cast("binary"), 256), 1, 6)))
    items = spark.range(count).select(F.col("id").alias("item_id"), text.alias("text"))
    cut = list(op.blocks(items))
    sizes = [sum(len(t.split(" ")) for _, t in b) for b in cut]
    assert max(sizes) <= op.BLOCK_WORDS and sum(sizes) == 1000 * count
    code = (
        "import resource, sys, pickle; from fleetpulse.llm import decontamination as op;"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; block = pickle.load(sys.stdin.buffer);"
        "symbols, found = op.automaton('k', block, 13);"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before, found.get_stats()['nodes_count'])"
    )
    largest = max(zip(sizes, cut))[1]
    told = subprocess.run([sys.executable, "-c", code], input=pickle.dumps(largest), capture_output=True, check=True)
    kilobytes, states = map(int, told.stdout.split())
    assert states <= 26 * op.BLOCK_WORDS + 1 and kilobytes < 400_000


def test_long_text(spark, frame):
    """A text of over 1 MB, hit at its start, its end and between."""
    item = [f"q{i}" for i in range(20)]
    filler = ["word"] * 100_000
    text = " ".join([*item, *filler, *item[3:16], *filler, *item[7:]])
    r = op.contamination(frame([(1, text)]), spark.createDataFrame([(9, " ".join(item))], "item_id BIGINT, text STRING")).first()
    assert (r.n_words, r.n_hit, list(r["items"])) == (200_046, 46, [9]) and len(text) > 10**6
    assert [text[s.start:s.end].split(" ") for s in r.spans] == [item, item[3:16], item[7:]]


def test_empty_tables(spark, frame):
    none = spark.createDataFrame([], "item_id BIGINT, text STRING")
    assert op.contamination(frame([]), none).count() == 0
    assert {r.n_hit for r in op.contamination(frame(ODD), none).collect()} == {0}


def test_query(spark, con):
    found = op.op6_decontamination(spark, FOLDER)
    assert compare(found, con, op.SQL) is None
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").collect()]
    some = {r.doc_id for r in found.where("n_hit > 0").collect()}
    docs = [(r.doc_id, r.text) for r in table(spark, FOLDER, "documents").collect() if r.doc_id in some or r.doc_id < 20]
    want = [(i, n, h, hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()) for i, n, h, ids in brute(docs, items)]
    rows = [(str(r.doc_id), r.n_words, r.n_hit, r.items_sha256) for r in found.collect() if r.doc_id in {d for d, _ in docs}]
    assert sorted(rows) == want and some
