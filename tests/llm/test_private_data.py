import hashlib
import random
import re
import time

from conftest import FOLDER
from fleetpulse.llm import private_data as op
from fleetpulse.llm.tables import table
from llm.conftest import ODD

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def odd_texts(n=300):
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@x", ".com", ".", "..", "+", "+1", "-", " ", "(", ")", "7", "192", "255", "256", "00", "000012", "4111 1111 1111 1111",
             "4111111111111111", "5500-0055-5555-5559", "é", "🙂", "x@y.z", "%x@y.zz", "1.2.3.4", "+1 (301) 555-0346", "(at)", "[dot]", "\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


DOCS = ODD + [(100 + i, t) for i, t in enumerate(odd_texts())] + [(900, "1" * 30000), (901, "a" * 30000 + "@b.c"), (902, "+1" * 8000), (903, "x@y.com " * 300)]


def test_base_is_what_plain_patterns_find(spark, frame):
    found = op.private_data(frame(DOCS)).collect()
    base = sorted((str(r.doc_id), r.text, [tuple(s) for s in r.base]) for r in found)
    assert base == sorted((str(i), t or "", plain_spans(t)) for i, t in DOCS)
    for r in found:
        spans = [tuple(s) for s in r.spans]
        assert set(map(tuple, r.base)) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (list(PLAIN).index(s[0]), s[1]))
    assert op.private_data(frame([])).count() == 0


def test_reliabilities_are_found():
    rng, counts = random.Random(2), {}
    right = (0.95, 0.8, 0.7)
    for _ in range(20000):
        true = rng.random() < 0.3
        votes = tuple((1 if (rng.random() < r) == true else -1) for r in right)
        counts[votes] = counts.get(votes, 0) + 1
    share, chances, likely = op.reliabilities(sorted(counts.items()))
    assert abs(share - 0.3) < 0.05
    assert all(abs(chances[j, 1, 2] - r) < 0.06 and abs(chances[j, 0, 0] - r) < 0.06 for j, r in enumerate(right))
    order = dict(zip(sorted(counts), likely))
    assert order[(1, 1, 1)] > 0.9 and order[(-1, -1, -1)] < 0.05


def test_the_classifier_adds_what_context_and_gazetteer_support(spark, frame):
    docs = [(i, f"write mail to joe{i}@mail{i}.example.com or call +1 (301) 555-03{i:02d}") for i in range(60)]
    docs += [(100 + i, f"build {i}.300.{i}.400 of section 12.30.45") for i in range(60)]
    docs += [(200, "contact mail joe (at) example (dot) com please"), (201, "see 999.999.999.999 there")]
    found = {r.doc_id: [s.kind for s in r.spans] for r in op.private_data(frame(docs)).collect()}
    assert found[200] == ["email"] and found[201] == [] and found[3] == ["email", "phone"] and found[103] == []


def test_redaction(spark, frame):
    rows = op.private_data(frame([(1, "é 🙂 x@y.com, 1.2.3.4!"), (2, "none"), (3, None), (4, "+1.2.3.4.5.6.7.8 x")]))
    found = {r.doc_id: r.t for r in rows.select("doc_id", op.redacted(rows.text, rows.spans).alias("t")).collect()}
    assert found[1] == "é 🙂 [EMAIL], [IP]!" and found[2] == "none" and found[3] == "" and found[4] == "[PHONE] x"


def test_query_is_native(spark):
    df = op.op9_private_data(spark, FOLDER)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
    found = {r.doc_id: r for r in df.collect()}
    rows = table(spark, FOLDER, "documents").collect()
    assert len(found) == len(rows)
    for r in rows:
        want = plain_spans(r.text)
        assert found[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [found[r.doc_id][f"n_{k}"] for k in PLAIN] == [sum(s[0] == k for s in want) for k in PLAIN]


def test_repetitive_texts_take_time_in_proportion(spark, frame):
    """A contact list of 20,000 addresses, and one whose candidates are not base spans, in seconds."""
    texts = ["x@y.com " * 20_000, "mail joe (at) home (dot) org, " * 5_000, "1.2.3.4 +1 301 555 0346 4111 1111 1111 1111 " * 3_000]
    rows = frame([(i, t) for i, t in enumerate(texts)])
    start = time.monotonic()
    weights = op.train(rows)
    trained = time.monotonic()
    found = {r.doc_id: r for r in op.find_spans(rows, weights).select("doc_id", "base", "spans").collect()}
    assert trained - start < 60 and time.monotonic() - trained < 60
    for i in (0, 2):
        assert [tuple(s) for s in found[i].base] == plain_spans(texts[i])
    assert found[0].spans == found[0].base and len(found[1].base) == 0
    shown = op.find_spans(rows.where("doc_id = 0"), weights)
    assert shown.select(op.redacted(shown.text, shown.spans).alias("t")).first().t == "[EMAIL] " * 20_000


def test_overlaps_as_pairs_say(spark):
    rng = random.Random(8)
    spans = lambda n: [(k, s, s + rng.randint(1, 6)) for k, s in sorted((rng.choice(["email", "ip"]), rng.randrange(60)) for _ in range(n))]
    rows = [(i, spans(rng.randrange(9)), [(*c, 1, 0, -1, 2) for c in spans(rng.randrange(9))]) for i in range(200)]
    kind = "kind string, start int, end int"
    df = spark.createDataFrame(rows, f"id int, base array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>, "
                               "loose array<struct<kind:string,start:int,end:int,pattern:int,gazetteer:int,context:int,shape:int>>")
    for r in df.select("id", "base", "loose").transform(lambda d: op._marked(d)).withColumnRenamed("loose", "marked").collect():
        assert [m.taken for m in r.marked] == [any(b.start < m.end and m.start < b.end for b in r.base) for m in r.marked]
