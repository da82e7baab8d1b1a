"""Each stage against a plain version of its decisions, on what the stage before it kept."""

import corpus_pipeline as pipeline
from conftest import FOLDER
from fleetpulse.llm import private_data, quality
from fleetpulse.llm.tables import table, written
from llm.conftest import ODD
from llm.test_decontamination import brute
from llm.test_packing import check_rows, padding
from llm.test_simhash import named, slow_components, slow_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def one_per_component(docs):
    tops = slow_components([slow_fingerprint(t) for _, t in docs])
    names = named([i for i, _ in docs], tops)
    return {i for (i, _), c in zip(docs, names) if i == c}


def test_stages(spark):
    docs, kept = table(spark, FOLDER, "documents"), None
    verdicts = {r.doc_id for r in quality.quality(docs, table(spark, FOLDER, "labels")).where("kept").collect()}
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").collect()]
    for name, stage in pipeline.STAGES:
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        docs = written(stage(spark, docs, FOLDER), "test")
        if name != "packing":
            assert docs.columns == COLUMNS
            kept = {r.doc_id: r for r in docs.collect()}
            assert docs.count() == len(kept)
        if name == "quality classifier":
            assert set(kept) == verdicts
        elif name == "near deduplication":
            assert set(kept) == one_per_component(rows)
        elif name == "benchmark decontamination":
            found = brute(rows, items)
            assert set(kept) == {int(i) for i, n, h, _ in found if not (h > 0 and 20 * h >= n)}
        elif name == "private data":
            spans = {r.doc_id: r.spans for r in private_data.private_data(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect()}
            for doc, text in rows:
                new, at = "", 0
                for s in sorted(spans[doc], key=lambda s: (s.start, -s.end)):
                    if s.start >= at:
                        new += text[at:s.start] + f"[{s.kind.upper()}]"
                    at = max(at, s.end)
                assert kept[doc].text == new + text[at:] and kept[doc].n_chars == len(kept[doc].text)
        else:
            assert padding(check_rows(docs.collect(), rows)) < 0.05


def test_run(spark):
    found = pipeline.run(spark, FOLDER)
    assert found.count() > 0 and {"doc_id", "sequence_id", "offset", "ids_crc32"} <= set(found.columns)


def test_odd_rows(spark, frame):
    docs = frame(ODD, extra=False).selectExpr("doc_id", "text", "'en' lang", "cast(null as string) source", "cast(null as bigint) n_chars")
    for name, stage in pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, FOLDER), "test")
        if name != "packing":
            assert docs.schema.names == before.schema.names
        empty = stage(spark, before.where("false"), FOLDER)
        assert empty.count() == 0
    assert docs.count() > 0
