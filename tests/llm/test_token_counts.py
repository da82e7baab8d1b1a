import random

import pytest
from tokenizers import Tokenizer

from conftest import FOLDER
from fleetpulse.llm import token_counts as op
from fleetpulse.llm.tables import scratch_path, table
from fleetpulse.llm.tokens import Encoder, public_path
from llm.conftest import ODD


def odd_texts(n=900):
    rng = random.Random(1)
    parts = ["The", "the", "'s", "don't", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "　", " ",
             "É", "é", "́", "ΣΑΣ", "İ", "12", "3.5", "漢字", "🙂", "<|endoftext|>", "<|startoftext|>", "!!", "</w>", "ﬁ", "_", "\x00", "ƒOO.", "Word,.", "ÖÄ,", "ßẞ.", "ΑΣ.", "İ.", ".", ",,"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(spark, file):
    plain = Tokenizer.from_file(public_path(file))
    texts = odd_texts() + [r.text for r in table(spark, FOLDER, "documents").select("text").limit(60).collect()]
    import numpy as np

    counts, ids = Encoder(public_path(file), True), Encoder(public_path(file), False)
    assert counts.kind == {"b": "led", "w": "words"}[file[0]]
    for t in texts:
        want = plain.encode(t, add_special_tokens=False).ids
        assert counts.encode(t) == len(want), repr(t)
        assert np.frombuffer(ids.encode(t), "<u4").tolist() == want, repr(t)


def test_generations(monkeypatch):
    monkeypatch.setattr("fleetpulse.llm.tokens.PIECES", 5)
    small, plain = Encoder(public_path("byte_bpe_50k.json"), True), Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    for t in odd_texts(100):
        assert small.encode(t) == len(plain.encode(t, add_special_tokens=False).ids)


def test_word_generations(monkeypatch):
    monkeypatch.setattr("fleetpulse.llm.tokens.PIECES", 5)
    path = public_path("word_bpe_49k.json")
    counts, ids, plain = Encoder(path, True), Encoder(path, False), Tokenizer.from_file(path)
    for t in odd_texts(200):
        want = plain.encode(t, add_special_tokens=False).ids
        assert counts.encode(t) == len(want) and memoryview(ids.encode(t)).cast("I").tolist() == want
        assert len(ids.young) <= 60 and not getattr(ids.old, "before", None)


def test_latin_words_and_punctuation():
    """Every character below U+0250, alone, doubled and within words of either case; runs of punctuation."""
    rng = random.Random(2)
    letters = [chr(k) for k in range(0x250)]
    ends = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    parts = ["The", "the", "HOUSE", "straße", "Éa", "'S", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "7", " ", "\n", "\u0338", "\u0307"]
    texts = [f"{c} {c}{c}. a{c}B {c}A!! x {c}" for c in letters] + [f"a{c} B{c}{d} {c}b. {c}{d}C" for c in ends for d in ends]
    texts += ["".join(rng.choice((parts, ends, letters)[rng.choice((0, 0, 1, 2))]) for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    path = public_path("word_bpe_49k.json")
    ids, plain = Encoder(path, False), Tokenizer.from_file(path)
    for t in texts:
        assert memoryview(ids.encode(t)).cast("I").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_plain_words_pass_by_normaliser_and_pattern(monkeypatch):
    """Only what is no plain word is encoded by the whole tokenizer, whatever the word's case and the
    punctuation behind it, and each word is encoded once."""
    path, asked, words = public_path("word_bpe_49k.json"), [], []
    ids, plain = Encoder(path, False), Tokenizer.from_file(path)
    whole = ids._encode
    monkeypatch.setattr(ids, "_encode", lambda pieces: asked.extend(pieces) or whole(pieces))
    texts = ["The the THE the, The!! the&&& house HOUSE. House%%% maß Maß, 12 don't", "the house the maß. 12!! Don't <|x"] * 3
    for t in texts:
        assert memoryview(ids.encode(t)).cast("I").tolist() == plain.encode(t, add_special_tokens=False).ids
    assert sorted(asked) == sorted([",", "!!", "&&&", ".", "%%%", "12", "don't", "12!!", "<|x"])
    ids = Encoder(path, False)
    made = ids.tokens_of
    monkeypatch.setattr(ids, "tokens_of", lambda word: words.append(word) or made(word))
    assert [len(ids.encode(t)) // 4 for t in texts] == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    assert sorted(words) == sorted(["the", "house", "ma\u00c3\u0141"])


def test_only_misses_are_encoded(spark, frame):
    cache, path = scratch_path(spark, "cache"), public_path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    want = sorted((str(i), len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    stored = lambda: spark.read.parquet(f"{cache}/*").count()
    for _ in range(2):
        found = op.count_tokens(frame(ODD), cache, path).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == want
        assert stored() == len({t or "" for _, t in ODD})
    op.count_tokens(frame([(77, "never seen"), (78, "one")]), cache, path).collect()
    assert stored() == len({t or "" for _, t in ODD}) + 1
    assert op.count_tokens(frame([]), cache, path).count() == 0
    lower = op.count_tokens(frame([(1, "SOME Words")]), cache, path, normalise=lambda c: __import__("pyspark.sql.functions").sql.functions.lower(c))
    assert lower.first().n_tokens == len(plain.encode("some words", add_special_tokens=False).ids)


def test_query(spark):
    plain = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    want = {r.doc_id: len(plain.encode(r.text, add_special_tokens=False).ids) for r in table(spark, FOLDER, "documents").collect()}
    found = op.op1_token_counts(spark, FOLDER).collect()
    assert {r.doc_id: r.n_tokens for r in found} == want and len(found) == len(want)
    assert all(r.over_limit == (r.n_tokens > 512) for r in found)


def test_a_second_run_of_the_query_encodes_nothing(spark, monkeypatch):
    want = sorted(map(tuple, op.op1_token_counts(spark, FOLDER).collect()))
    monkeypatch.setattr(op, "mapped", lambda rows, each, schema: spark.createDataFrame([], schema) if not rows.count() else 1 / 0)
    assert sorted(map(tuple, op.op1_token_counts(spark, FOLDER).collect())) == want
