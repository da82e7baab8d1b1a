"""Packing into windows by non-negative least squares over combinations of lengths.

A document's ids are cut every `WINDOW` ids; what is left of it, its remainder, is shorter than a
window. Only the histogram of remainder lengths (at most `WINDOW` numbers, whatever the size of the
table) reaches the driver. There, combinations of few lengths that fill a window exactly are
enumerated, and repeat counts are solved so that together they use the histogram up as nearly as
possible (non-negative least squares, one coordinate at a time). Rounded counts become windows; what
is over is packed greedily, largest first, and where a gap of `BLOCK` ids or more stays, a remainder
is cut at a multiple of `BLOCK` to fill it.

The plan says which ranks of a length go to which windows. Ranks within a length come from counts per
length and chunk, so a length that a third of all documents share is spread over all chunks. A cut
piece's CRC is composed from those of its blocks, so ids are made once and never stored or moved.
"""

import bisect
import zlib
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.tables import mapped, table, texts, written
from fleetpulse.llm.tokens import encoder, public_path

WINDOW, BLOCK, END, SPREAD, SWEEPS = 2048, 64, 1, 12, 30


# ---- CRCs of parts -------------------------------------------------------------------------------

def _times(matrix: tuple[int, ...], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


@cache
def _zeros(n: int) -> tuple[int, ...]:
    """What `n` zero bytes do to a CRC-32, as a matrix over bits (columns)."""
    if n == 0:
        return tuple(1 << i for i in range(32))
    if n == 1:
        bit = (0xEDB88320, *(1 << i for i in range(31)))
        for _ in range(3):
            bit = tuple(_times(bit, c) for c in bit)
        return bit
    half = _zeros(n // 2)
    out = tuple(_times(half, c) for c in half)
    return tuple(_times(_zeros(1), c) for c in out) if n % 2 else out


def joined_crc(parts: list[int], lengths: list[int]) -> int:
    """The CRC-32 of byte strings one after the other, from theirs and their lengths."""
    crc = 0
    for part, n in zip(parts, lengths):
        crc = _times(_zeros(n), crc) ^ part
    return crc


# ---- the plan --------------------------------------------------------------------------------------

def combinations_of(lengths: list[int], window: int = WINDOW) -> list[tuple[int, ...]]:
    """Combinations of these lengths that fill a window: pairs, copies of one with one or two others,
    and triples whose second length is one of `SPREAD` spread over the possible ones."""
    have, out = set(lengths), set()
    for a in lengths:
        for times in range(1, window // a + 1):
            rest = window - times * a
            if rest == 0 or rest in have:
                out.add(tuple(sorted((a,) * times + ((rest,) if rest else ()))))
            if times > 8:
                break
        low = bisect.bisect_left(lengths, 1)
        high = bisect.bisect_right(lengths, window - a - 1)
        for k in range(SPREAD):
            if high > low:
                b = lengths[low + (high - low) * (2 * k + 1 + a % 2) // (2 * SPREAD + 1)]
                if window - a - b in have:
                    out.add(tuple(sorted((a, b, window - a - b))))
    return sorted(out)


def repeat_counts(combos: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = SWEEPS) -> list[float]:
    """x >= 0 that makes the sum of x times each combination's lengths nearest to the histogram."""
    left = {k: float(v) for k, v in histogram.items()}
    columns = [[(a, c.count(a)) for a in set(c)] for c in combos]
    norms, x = [sum(m * m for _, m in col) for col in columns], [0.0] * len(combos)
    for _ in range(sweeps):
        moved = 0.0
        for j, col in enumerate(columns):
            step = sum(m * left[a] for a, m in col) / norms[j]
            new = max(0.0, x[j] + step)
            if new != x[j]:
                step, x[j] = new - x[j], new
                moved = max(moved, abs(step))
                for a, m in col:
                    left[a] -= m * step
        if moved < 0.01:
            break
    return x


class Stock:
    """Remainders that are not yet placed: for each size, ranges of ranks of a length, and how much of
    their beginning has been used."""

    def __init__(self, histogram: dict[int, int]):
        self.ranges = {n: [[n, 0, 0, count]] for n, count in histogram.items() if count}
        self.sizes = sorted(self.ranges)

    def count(self, size: int) -> int:
        return sum(hi - lo for *_, lo, hi in self.ranges.get(size, ()))

    def largest(self, most: int) -> int | None:
        k = bisect.bisect_right(self.sizes, most)
        return self.sizes[k - 1] if k else None

    def take(self, size: int, n: int) -> list[tuple[int, int, int, int]]:
        """`n` pieces of a size, as (length, used, first rank, last rank + 1)."""
        out, ranges = [], self.ranges[size]
        while n:
            length, used, lo, hi = ranges[-1]
            k = min(n, hi - lo)
            out.append((length, used, lo, lo + k))
            n -= k
            if lo + k == hi:
                ranges.pop()
            else:
                ranges[-1][2] = lo + k
        if not ranges:
            del self.ranges[size]
            self.sizes.remove(size)
        return out

    def add(self, size: int, length: int, used: int, lo: int, hi: int) -> None:
        if size not in self.ranges:
            bisect.insort(self.sizes, size)
        self.ranges.setdefault(size, []).append([length, used, lo, hi])


def plan(histogram: dict[int, int], window: int = WINDOW, block: int = BLOCK) -> list[tuple[int, ...]]:
    """Rows (length, lo, hi, used, size, per, first, offset): of the remainders of `length` with ranks
    from `lo` to `hi`, the part of `size` ids after the first `used` goes, `per` to a window from
    window `first` on, to `offset` and the places after it."""
    stock, rows, first = Stock(histogram), [], 0

    def windows(slots: list[tuple[int, int]], n: int) -> None:
        """`n` windows, each with so many pieces of each size of `slots`, in this order."""
        nonlocal first
        offset = 0
        for size, per in slots:
            done = 0
            for length, used, lo, hi in stock.take(size, n * per):
                # A range may end within a window, or begin in one: whole windows are one row, and the
                # pieces of split ones a row each.
                while lo < hi:
                    k, at = divmod(done, per)
                    whole = (hi - lo) // per * per if at == 0 else 0
                    if whole:
                        rows.append((length, lo, lo + whole, used, size, per, first + k, offset))
                        lo, done = lo + whole, done + whole
                    else:
                        step = min(hi - lo, per - at)
                        rows.append((length, lo, lo + step, used, size, per, first + k, offset + at * size))
                        lo, done = lo + step, done + step
            offset += size * per
        first += n

    if histogram.get(window):
        windows([(window, 1)], histogram[window])
    short = {n: c for n, c in histogram.items() if c and n < window}
    combos = combinations_of(sorted(short), window)
    counts = repeat_counts(combos, short)
    for j in sorted(range(len(combos)), key=lambda j: -counts[j]):
        slots = [(a, combos[j].count(a)) for a in sorted(set(combos[j]))]
        n = min(round(counts[j]), *(stock.count(a) // m for a, m in slots))
        if n > 0:
            windows(slots, n)
    while stock.sizes:
        slots, rest, used = [], window, {}
        while rest and (size := _fit(stock, rest, used)):
            per = min(rest // size, stock.count(size) - used.get(size, 0))
            if slots and slots[-1][0] == size:
                break
            slots.append((size, per))
            used[size] = used.get(size, 0) + per
            rest -= size * per
        n = min(stock.count(size) // per for size, per in slots)
        gap = rest // block * block
        longer = [s for s in stock.sizes if s > gap and stock.count(s) - used.get(s, 0) > 0] if gap else []
        if longer:
            size = longer[-1]
            n = min(n, max(1, (stock.count(size) - used.get(size, 0) * n) if size not in used else 1))
            if size in used and stock.count(size) < used[size] * n + n:
                n = 1
            if stock.count(size) >= used.get(size, 0) * n + n:
                for length, done, lo, hi in stock.take(size, n):
                    stock.add(gap, length, done, lo, hi)
                    stock.add(size - gap, length, done + gap, lo, hi)
                # The heads were added last, so they are taken first.
                slots = [(s, p + (s == gap)) for s, p in slots] if gap in used else [*slots, (gap, 1)]
        windows(slots, n)
    return rows


def _fit(stock: Stock, rest: int, used: dict) -> int | None:
    """The largest size that fits and is not used up."""
    size = stock.largest(rest)
    while size is not None and stock.count(size) <= used.get(size, 0):
        size = stock.largest(size - 1)
    return size


# ---- rows ------------------------------------------------------------------------------------------

PIECES = "doc_id BIGINT, doc_tokens BIGINT, start BIGINT, length INT, crc BIGINT, blocks ARRAY<INT>"
PACKED = "doc_id BIGINT, start BIGINT, length BIGINT, ids_crc32 BIGINT, doc_tokens BIGINT, sequence_id BIGINT, offset BIGINT"


def cut_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents cut every `WINDOW` ids, with the CRC of each piece and of each block of a remainder."""
    end = END.to_bytes(4, "little")

    def each(batch):
        out: dict = {c: [] for c in ("doc_id", "doc_tokens", "start", "length", "crc", "blocks")}
        encoded = encoder(tokenizer, False).encode_all(batch["text"].to_pylist())
        for doc, ids in zip(batch["doc_id"].to_pylist(), encoded):
            ids += end
            n = len(ids) // 4
            for start in range(0, n, WINDOW):
                part = ids[4 * start:4 * (start + WINDOW)]
                size = len(part) // 4
                blocks = [zlib.crc32(part[k:k + 4 * BLOCK]) for k in range(0, len(part), 4 * BLOCK)] if size < WINDOW else []
                for c, v in zip(out, (doc, n, start, size, zlib.crc32(part), np.array(blocks, np.uint32).view(np.int32))):
                    out[c].append(v)
        return out

    return mapped(texts(docs), each, PIECES)


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of all documents with their place: `doc_id`, `start`, `length`, `ids_crc32`,
    `doc_tokens`, `sequence_id` and `offset`.

    Null and empty texts are the end id alone. Rows with a null or repeated `doc_id` are each packed;
    other columns are ignored; an empty table gives no row.
    """
    spark = docs.sparkSession
    pieces = written(cut_documents(docs, tokenizer), "pieces")
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "crc"), F.lit(chunks)))
    counts = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan(histogram)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "crc")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["length", "chunk"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("own"))
    names = ("length", "lo", "hi", "used", "size", "per", "first", "at")
    table_of = spark.createDataFrame(rows, ", ".join(f"{n} BIGINT" for n in names)).withColumnRenamed("length", "plan_length")
    placed = ranked.join(
        F.broadcast(table_of),  # at most a few rows for each of `WINDOW` lengths
        (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")),
    )
    step = F.col("rank") - F.col("lo")
    placed = placed.select(
        "doc_id", "doc_tokens", "start", "length", "crc", "used", "size",
        F.when(F.col("size") < F.col("length"), F.col("blocks")).alias("blocks"),
        (F.col("first") + F.floor(step / F.col("per"))).alias("sequence_id"),
        (F.col("at") + step % F.col("per") * F.col("size")).alias("offset"),
    )

    def finish(batch):
        out = {c: batch[c] for c in ("doc_id", "doc_tokens", "sequence_id", "offset")} | {"length": batch["size"]}
        out |= {"start": [], "ids_crc32": []}
        for start, length, crc, used, size, blocks in zip(*(batch[c].to_pylist() for c in ("start", "length", "crc", "used", "size", "blocks"))):
            out["start"].append(start + used)
            if size < length:
                parts = [b & 0xFFFFFFFF for b in blocks[used // BLOCK:-(-(used + size) // BLOCK)]]
                sizes = [4 * min(BLOCK, used + size - at) for at in range(used, used + size, BLOCK)]
                crc = joined_crc(parts, sizes)
            out["ids_crc32"].append(crc)
        return out

    return mapped(placed, finish, PACKED)


def op5_packing(spark, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_path("word_bpe_49k.json"))
