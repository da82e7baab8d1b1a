import base64
import hashlib

import numpy as np
import pytest
import tiktoken
from conftest import FOLDER

from fleetpulse.llm import byte_bpe as op
from fleetpulse.llm.tables import table
from fleetpulse.llm.tokens import public_path
from llm.conftest import ODD

PATH, PATTERN = public_path("byte_bpe_50k.tiktoken"), op.public_pattern()


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(rows):
    return sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in rows)


#: Contractions, spaces and line ends where chunks meet, runs longer than an overlap, other scripts.
LONG = [
    (30, "we'll they've I'd " * 40), (31, "a \n\n b\n\n\n  c\t \t" * 30), (32, "x" * 700), (33, " " * 500 + "end"), (34, "12345 67,89!? " * 30),
    (35, "漢字かな交じり文 ünï " * 40), (36, "\n" * 333), (37, "word " * 100 + "y" * 300 + " word" * 100), (38, "<|endoftext|> 's'll" * 25),
    (39, "x" * 700), (39, "x" * 700), (None, "x" * 700), (40, "'" * 90 + "ll" * 90),
]


@pytest.mark.parametrize("width, overlap", [(op.CHUNK, op.OVERLAP), (64, 16), (37, 5), (16, 16), (8, 1)])
def test_as_the_library(spark, frame, library, width, overlap):
    docs = ODD + LONG
    found = op.decode(op.encode(frame(docs), PATH, PATTERN, width, overlap), PATH, PATTERN).collect()
    assert ids_of(found) == sorted((str(d), library.encode_ordinary(t or "")) for d, t in docs)
    assert sorted(bytes(r.bytes) for r in found) == sorted((t or "").encode() for _, t in docs)


def test_chunks_of_a_text_agree_with_the_whole(library):
    """Every cut of a hard text: what two chunks share is what the whole text has."""
    import regex

    text = "a  b\n\n c's 'll d've \t\t!? 12 3x" * 3
    true = {0}
    for m in regex.finditer(PATTERN, text):
        true.add(m.end())
    for width in range(1, 20):
        for overlap in range(1, width + 1):
            tail = None
            for start, chunk, last in op.chunks_of(text, width, overlap):
                ends, good = op.boundaries(regex.findall(PATTERN, chunk), len(chunk), last)
                places = [e + start for e in ends[:good]]
                shared = [p for p in places if p in tail] if tail is not None else [0]
                if not shared:
                    break
                assert {p for p in places if p >= shared[0]} <= true
                tail = {p for p in places if p >= start + width and p >= shared[0]}


def test_very_long_texts(spark, frame, library):
    docs = [(1, "z" * 1_200_000), (2, "the quick brown fox's tail 42 \n" * 40_000), (3, " " * 1_100_000 + "e"), (4, "")]
    found = ids_of(op.encode(frame(docs), PATH, PATTERN).collect())
    assert [len(i) for _, i in found][3] == 0
    assert found[1][1] == library.encode_ordinary(docs[1][1])
    for (_, ids), (_, text) in zip(found, docs):
        assert library.decode_bytes(ids) == text.encode()


def test_empty_table_and_wrong_overlap(spark, frame):
    assert op.encode(frame([]), PATH, PATTERN).count() == 0
    with pytest.raises(ValueError):
        op.encode(frame([]), PATH, PATTERN, 10, 11)


def test_query(spark, library):
    found = op.op13_byte_bpe(spark, FOLDER)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for r in table(spark, FOLDER, "documents").collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found.collect())) == sorted(want)
