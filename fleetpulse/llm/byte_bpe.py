"""Byte-level BPE by a table of ranks: encoding in overlapping chunks, and decoding.

A pattern cuts a text into pieces; each piece is encoded on its own. Texts of at most `CHUNK`
characters are cut where they are read. Longer ones go the long way:

1. *Chunks* of `CHUNK` characters and `OVERLAP` more are dealt out and cut in parallel. The cut at a
   chunk's start may be inside a piece, and its last pieces may go on after its end.
2. *Stitching.* Where a piece starts depends on nothing before it, so from the first boundary that two
   neighbours share in their overlap both cut alike. There the later chunk takes over. Boundaries whose
   pieces looked at fewer than `MARGIN` further characters before the chunk's end don't count.
3. Texts with neighbours that share no boundary (a piece longer than the overlap) are cut again in
   chunks `GROW` times as large, at last in one.
4. Pieces are encoded chunk by chunk, and a text's ids put together in the order of its chunks.

Decoding looks up the bytes of each id and concatenates them.
"""

import base64
from array import array
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.tables import hex_digest, mapped, table, texts, written
from fleetpulse.llm.tokens import public_path

CHUNK, OVERLAP, MARGIN, GROW = 65_536, 1_024, 4, 8
PIECES, PIECE_CHARS = 600_000, 64
_CODECS: dict = {}


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Codec:
    """Pieces of texts, their ids as little-endian unsigned 32-bit numbers, and bytes of ids."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.cut = regex.compile(pattern).findall
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.young: dict = {}
        self.old: dict = {}

    def _one(self, piece: str) -> bytes:
        return array("I", self.encoding._encode_single_piece(piece)).tobytes()

    def ids(self, pieces: list[str]) -> bytes:
        """Pieces seen before are looked up in two generations, of which the older is dropped in time."""
        found = list(map(self.young.get, pieces))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    piece = pieces[i]
                    found[i] = self.young.get(piece) or self.old.get(piece) or self._one(piece)
                    if len(piece) <= PIECE_CHARS:
                        self.young[piece] = found[i]
        if len(self.young) > PIECES:
            self.old, self.young = self.young, {}
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def chunks_of(text: str, width: int, overlap: int) -> list[tuple[int, str, bool]]:
    """(start, characters, whether the text ends here)."""
    starts = range(0, max(len(text), 1), width)
    return [(s, text[s:s + width + overlap], s + width >= len(text)) for s in starts]


def boundaries(pieces: list[str], size: int, last: bool) -> tuple[list[int], int]:
    """Where pieces start and end, and how many of these places the chunk's end can't have changed."""
    ends = [0, *accumulate(map(len, pieces))]
    good = len(ends)
    while not last and good > 1 and (ends[good - 2] + MARGIN > size or ends[good - 1] + 2 > size):
        good -= 1
    return ends, good


def _long_ids(long: DataFrame, path: str, pattern: str, width: int, overlap: int) -> DataFrame:
    """(`digest`, `ids`) of distinct texts (`digest`, `text`)."""

    def split(batch):
        out: dict = {c: [] for c in ("digest", "k", "start", "last", "chunk")}
        for digest, text in zip(batch["digest"].to_pylist(), batch["text"].to_pylist()):
            for k, (start, chunk, last) in enumerate(chunks_of(text, width, overlap)):
                for c, v in zip(out, (digest, k, start, last, chunk)):
                    out[c].append(v)
        return out

    def cut(batch):
        out: dict = {c: batch[c] for c in ("digest", "k", "start", "chunk")} | {"ends": [], "head": [], "tail": []}
        for start, last, chunk in zip(*(batch[c].to_pylist() for c in ("start", "last", "chunk"))):
            ends, good = boundaries(codec(path, pattern).cut(chunk), len(chunk), last)
            places = np.array(ends[:good], np.int64) + start
            out["ends"].append(np.array(ends, np.int32).tobytes())
            out["head"].append(places[places <= start + overlap])
            out["tail"].append(places[places >= start + width])
        return out

    dealt = mapped(long, split, "digest STRING, k INT, start BIGINT, last BOOLEAN, chunk STRING").repartition("digest", "k")
    ddl = "digest STRING, k INT, start BIGINT, chunk STRING, ends BINARY, head ARRAY<BIGINT>, tail ARRAY<BIGINT>"
    chunks = written(mapped(dealt, cut, ddl), "chunks")
    order = Window.partitionBy("digest").orderBy("k")
    shared = F.array_min(F.array_intersect("head", F.lag("tail").over(order)))
    stitched = chunks.select("digest", "k", F.when(F.col("k") == 0, F.lit(0)).otherwise(shared).alias("begin"))
    stitched = written(stitched.select("*", F.lead("begin").over(order).alias("finish")), "stitched")
    apart = stitched.where("begin IS NULL").select("digest").distinct()
    whole = chunks.join(stitched.join(apart, "digest", "left_anti"), ["digest", "k"])

    def encode(batch):
        out: dict = {"digest": batch["digest"], "k": batch["k"], "ids": []}
        for start, chunk, ends, begin, finish in zip(*(batch[c].to_pylist() for c in ("start", "chunk", "ends", "begin", "finish"))):
            places = np.frombuffer(ends, np.int32)
            first = int(np.searchsorted(places, begin - start))
            after = len(places) - 1 if finish is None else int(np.searchsorted(places, finish - start))
            at = places[first:after + 1].tolist()
            out["ids"].append(codec(path, pattern).ids([chunk[a:b] for a, b in zip(at, at[1:])]))
        return out

    narrow = whole.select("digest", "k", "start", "chunk", "ends", "begin", "finish")
    parts = mapped(narrow, encode, "digest STRING, k INT, ids BINARY").groupBy("digest").agg(
        F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts")
    )

    def join(batch):
        return {"digest": batch["digest"], "ids": [b"".join(p["ids"] for p in parts) for parts in batch["parts"].to_pylist()]}

    ids = mapped(parts, join, "digest STRING, ids BINARY")
    if apart.isEmpty():
        return ids
    rest = written(long.join(apart, "digest", "left_semi"), "apart")
    return ids.union(_long_ids(rest, path, pattern, width * GROW, overlap * GROW))


def encode(docs: DataFrame, path: str, pattern: str, width: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`doc_id` and `ids` (little-endian unsigned 32-bit numbers) of every document.

    `path` is a file of ranks (a token in base64 and its rank a line) that all workers have; `pattern` must
    cover every character. Null text counts as empty and has no ids; strings of special tokens are
    ordinary text. Rows with a null or repeated `doc_id` are each encoded; other columns are ignored;
    an empty table gives no row.
    """
    if not 0 < overlap <= width:
        raise ValueError("the overlap must be above 0 and at most the width of a chunk")
    rows = texts(docs)

    def whole(batch):
        own = codec(path, pattern)
        return {"doc_id": batch["doc_id"], "ids": [own.ids(own.cut(t)) for t in batch["text"].to_pylist()]}

    short = mapped(rows.where(F.length("text") <= width), whole, "doc_id BIGINT, ids BINARY")
    long = rows.where(F.length("text") > width).withColumn("digest", F.sha2("text", 256))
    distinct = written(long.groupBy("digest").agg(F.first("text").alias("text")), "long-texts")
    if distinct.isEmpty():
        return short
    ids = written(_long_ids(distinct, path, pattern, width, overlap), "long-ids")
    return short.union(long.select("doc_id", "digest").join(ids, "digest").select("doc_id", "ids"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of `encoded` (`doc_id`, `ids`) with `bytes`, which no id leaves empty."""

    def each(batch):
        own = codec(path, pattern)
        return {"doc_id": batch["doc_id"], "ids": batch["ids"], "bytes": [own.decode(i) for i in batch["ids"].to_pylist()]}

    return mapped(encoded.select("doc_id", "ids"), each, "doc_id BIGINT, ids BINARY, bytes BINARY")


def op13_byte_bpe(spark, folder: str) -> DataFrame:
    path, pattern = public_path("byte_bpe_50k.tiktoken"), public_pattern()
    back = decode(encode(table(spark, folder, "documents"), path, pattern), path, pattern)
    return back.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), hex_digest(F.col("ids")).alias("ids_sha256"),
        hex_digest(F.col("bytes")).alias("decoded_sha256"),
    )
