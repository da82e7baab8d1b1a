"""SimHash near duplicates with pivot distance tables.

Equal fingerprints are one class. Fingerprints are dealt to cells so that any two within `LINK` bits
share one: the bits are cut into `BLOCKS` blocks, at least `KEPT` of which are equal in such a pair,
and each choice of that many blocks with their content is a cell. Within a cell, each fingerprint has
a table row of its Hamming distances to `PIVOTS` fixed references; as distances obey the triangle
inequality, a pair whose rows differ by more than `LINK` in any coordinate is discarded, and the
survivors are verified. (Distances of random fingerprints to a reference lie so close together that
over half of all pairs pass any one pivot; so pivots discard pairs but can't deal rows to tasks.)

A cell yields only enough links to join what is linked in it: a search from member to member takes
each found member out, so a cell of thousands of near copies is no list of pairs. A cell of over
`CELL` members is not searched but dealt again by the bits that are still free.
"""

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.components import components
from fleetpulse.llm.tables import mapped, small_batches, table, texts, written

SHINGLE, LINK, BLOCKS, KEPT, PIVOTS, CELL, LEAST_FREE = 4, 4, 7, 3, 16, 20_000, 14
#: The 64-bit golden ratio: multiples of it, mixed, are the references.
GOLDEN, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
HASHED_AT_ONCE = 1 << 16


def fingerprint(text: str) -> int:
    """Bit i is set if more than half of the shingles' hashes have it."""
    import xxhash

    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = len(words) - size + 1
    hashed, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, HASHED_AT_ONCE):
        part = zip(starts[k:min(n, k + HASHED_AT_ONCE)].tolist(), (ends[k + size - 1:k + HASHED_AT_ONCE + size - 1] - 1).tolist())
        found = np.array([hashed(joined[a:b], 42) for a, b in part], dtype=">u8")
        counts += np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _text_hash(column: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text_hash` and the fingerprint `fp` as a long with the same bits, for every row."""

    def each(batch):
        made = np.array([fingerprint(t) for t in batch["text"].to_pylist()], dtype=np.uint64)
        return {"doc_id": batch["doc_id"], "text_hash": batch["text_hash"], "fp": made.view(np.int64)}

    return mapped(texts(docs, _text_hash("text").alias("text_hash")), each, "doc_id BIGINT, text_hash BIGINT, fp BIGINT")


@cache
def cells_of(mask: int) -> tuple[int, ...]:
    """The masks of the cells into which a cell that fixes the bits `mask` is dealt."""
    blocks = np.array_split([b for b in range(64) if not mask >> b & 1], BLOCKS)
    bits = [sum(1 << int(b) for b in block) for block in blocks]
    return tuple(mask | sum(chosen) for chosen in combinations(bits, KEPT))


@cache
def references() -> np.ndarray:
    out = []
    for i in range(1, PIVOTS + 1):
        x = i * GOLDEN & MASK
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
        out.append(x ^ x >> 27)
    return np.array(out, dtype=np.uint64)


def distances(fps: np.ndarray) -> np.ndarray:
    """The pivot table: a row of distances to the references for each fingerprint."""
    return np.bitwise_count(fps[:, None] ^ references()[None, :]).astype(np.int8)


def _near(fps: np.ndarray, table: np.ndarray, fp, row) -> np.ndarray:
    """Which of `fps` are within `LINK` bits of `fp`."""
    near = np.abs(table[:, 0] - row[0]) <= LINK
    at = np.flatnonzero(near)
    at = at[np.abs(table[at] - row).max(axis=1, initial=0) <= LINK]
    return at[np.bitwise_count(fps[at] ^ fp) <= LINK]


def cell_links(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all members of a cell which links within the cell join."""
    free, table, links = fps, distances(fps), []
    while len(free) > 1:
        todo = [(free[0], table[0])]
        free, table = free[1:], table[1:]
        while todo and len(free):
            fp, row = todo.pop()
            at = _near(free, table, fp, row)
            if len(at):
                links += [(int(fp), int(x)) for x in free[at]]
                todo += zip(free[at], table[at])
                free, table = np.delete(free, at), np.delete(table, at, axis=0)
    return links


_LINK = "mask BIGINT, u BIGINT, v BIGINT"


def _searched(rows: DataFrame) -> DataFrame:
    """Links of the cells of `rows` (mask, fp), or rows (mask, fp, null) of cells to be dealt again.

    A row with mask 0 has no cell yet."""
    rows = rows.mapInArrow(_deal, "mask BIGINT, key BIGINT, fp BIGINT")
    # The cell is told by mask and key; sorting brings its members together, batch borders or not.
    rows = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    return rows.mapInArrow(_search, _LINK)


def _deal(batches):
    for batch in batches:
        masks, fps = (batch.column(c).to_numpy().view(np.uint64) for c in ("mask", "fp"))
        for mask in np.unique(masks):
            own = fps[masks == mask]
            for m in cells_of(int(mask)):
                key = own & np.uint64(m)
                made = np.full(len(own), m, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (made, key, own)], names=["mask", "key", "fp"])


def _search(batches):
    names = ["mask", "u", "v"]
    rest = [np.zeros(0, np.uint64)] * 3
    out: list = [[], [], []]

    def search(mask, key, fp):
        """All cells in these rows are whole."""
        if not len(fp):
            return
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])]))
        sizes = np.diff(np.append(starts, len(fp)))
        two = starts[sizes == 2]  # most cells of more than one member: all at once
        a, b = fp[two], fp[two + 1]
        kept = np.abs(distances(a) - distances(b)).max(axis=1, initial=0) <= LINK
        a, b = a[kept], b[kept]
        near = np.bitwise_count(a ^ b) <= LINK
        out[1] += a[near].tolist()
        out[2] += b[near].tolist()
        out[0] += [0] * int(near.sum())
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            members, m = fp[start:start + size], int(mask[start])
            if size > CELL and 64 - m.bit_count() > LEAST_FREE:
                out[0] += [m] * size
                out[1] += members.tolist()
                out[2] += [None] * size
            else:
                for u, v in cell_links(members):
                    out[0].append(0)
                    out[1].append(u)
                    out[2].append(v)

    def flush():
        signed = lambda xs: pa.array([x if x is None or x < 1 << 63 else x - (1 << 64) for x in xs], pa.int64())
        made = pa.RecordBatch.from_arrays([signed(x) for x in out], names=names)
        for x in out:
            x.clear()
        return made

    for batch in batches:
        rows = [np.concatenate([r, batch.column(c).to_numpy().view(np.uint64)]) for r, c in zip(rest, ("mask", "key", "fp"))]
        if not len(rows[0]):
            continue
        last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = last[-1] + 1 if len(last) else 0  # the last cell may go on in the next batch
        search(*(r[:cut] for r in rows))
        rest = [r[cut:] for r in rows]
        if out[0]:
            yield flush()
    search(*rest)
    yield flush()


def near_links(fps: DataFrame) -> DataFrame:
    """Links (`u`, `v`) between the distinct fingerprints `fp`, enough to join all that are linked."""
    small_batches(fps.sparkSession)
    todo, found = fps.select(F.lit(0).cast("long").alias("mask"), "fp").distinct(), None
    while True:
        made = written(_searched(todo), "near")
        links = made.where("v IS NOT NULL").select("u", "v")
        found = links if found is None else found.union(links)
        todo = made.where("v IS NULL").select("mask", F.col("u").alias("fp"))
        if todo.isEmpty():
            return found


def _grouped(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text_hash`, `fp`, the `root` of its component and the component's `component_id`."""
    made = written(fingerprints(docs), "fingerprints")
    classes = made.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(classes))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return made.join(rooted.join(smallest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: `doc_id`, `fp` and `component_id`, the smallest `doc_id` that can be reached
    over links between fingerprints at `LINK` or fewer differing bits.

    Null and empty texts, and those without words, have fingerprint 0 and are linked like any other.
    A null `doc_id` gets a component like the rest but never names one, unless all of a component are
    null. Repeated rows are each returned; other columns are ignored; an empty table gives no row.
    """
    return _grouped(docs).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near duplicates, with all their columns: of each component the row
    with the least `doc_id` stays, a null one last; of several with that id, the text with the least
    hash, once."""
    found = _grouped(docs)
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    stay = found.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.doc_id").alias("id"), F.col("m.text_hash").alias("hash"))
    times = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    stay = stay.join(times, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))).select("id", "hash", "n")
    stay = written(stay, "stay")

    def rows(ids):
        same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.id")) & (_text_hash("d.text") == F.col("s.hash"))
        return docs.alias("d").join(ids.hint("shuffle_hash").alias("s"), same, "left_semi")

    return rows(stay.where("n = 1")).unionAll(rows(stay.where("n > 1")).dropDuplicates(["doc_id", "text"]))


def op7_simhash(spark, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
