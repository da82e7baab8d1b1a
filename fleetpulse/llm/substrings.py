"""Exact substring deduplication with a sparse suffix array.

A byte is removed if a string of `SIZE` bytes that covers it also starts earlier, in a smaller
document or before in the same one. Sorting every suffix would move each byte `SIZE` times; so only
*anchors* are sorted: of the `KEY`-byte strings that begin in a window, the one with the least hash.
Every string of `SIZE` bytes contains an anchor, and equal strings contain the same ones, so an equal
string is found at an anchor with as much equal text on both sides.

1. The anchors' keys are dealt by hash, sorted, and equal neighbours are marked; a key at the border of a
   batch is kept too, as its equal may be across. A key that a sample of documents already shows in two
   texts is known to be found twice, needs no neighbour, and is dealt by key and text: so a key in a third of
   all documents is spread over all tasks. What is left are the keys found twice, and perhaps a few more.
2. Copies of whole texts are told by digest: the first stands for all, the others are removed whole.
   Texts that stand for themselves and hold such keys are the candidates.
3. Only these anchors get their context: `SIZE` bytes to the right and `SIZE - KEY` to the left.
   Contexts that are wholly equal to an earlier one of the task are settled there, and what they cover is
   moved as merged ranges.
4. Suffixes are range-partitioned by their leading `KEY` bytes; the splitters come from the suffixes of a
   sample of candidates, so nothing is computed twice. Buckets are sorted by multikey quicksort (eight bytes
   at a time, only among suffixes that are still tied), to the right and to the left. What neighbours have
   in common gives, for each split of `SIZE` into left and right bytes, the classes of equal strings; all
   but the earliest of a class are found again. No class crosses the border of a bucket, as equal leading
   bytes have one bucket. A key with over `CROWD` suffixes is not sorted in one task: its strings are dealt
   out one by one and aggregated. Where the sample shows such a key, its suffixes are spread before that.

The samples decide where rows go, never what is found.

Texts are moved compressed, and told apart by a 64-bit hash.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.tables import mapped, small_batches, table, texts, written

SIZE, KEY, CROWD, AT_ONCE = 100, 24, 200_000, 60_000
#: Documents that are looked at to deal rows out, most keys and leading strings that are taken from them,
#: times that a key must be seen to be taken for a crowd, and rows of a bucket.
LOOKED, TAKEN, SEEN, BUCKET = 4_000, 100_000, 10, 200_000
LEFT = SIZE - KEY
_MIX, MASK64 = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1


# ---- anchors -----------------------------------------------------------------------------------------

def key_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each `KEY`-byte string: of 8-byte words put together, mixed."""
    n = len(data) - KEY + 1
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    words = np.ascontiguousarray(words).view("<u8").ravel()
    out = np.zeros(n, np.uint64)
    for k in range(0, KEY, 8):
        out = (out ^ words[k:k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9) ^ (out >> np.uint64(32))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and key hashes of the anchors; none if the text is shorter than `SIZE`."""
    if len(data) < SIZE:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = key_hashes(data)
    width = SIZE - KEY + 1
    least, have = hashes, 1  # least hash of the `have` places from each on, by doubling
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    # A place is an anchor if its hash is the least of a window that holds it.
    spread, have = least, 1
    pad = np.zeros(width - 1, np.uint64)
    spread = np.concatenate([pad, least, pad])
    while have < width:
        step = min(have, width - have)
        spread = np.maximum(spread[:-step], spread[step:])
        have += step
    at = np.flatnonzero(hashes == spread)
    return at, hashes[at]


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace"), np.uint8)


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(SIZE, np.uint8)])


def contexts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of bytes to the right, and to the left from near to far, and how many of them there are."""
    padded = np.lib.stride_tricks.sliding_window_view(_padded(data), LEFT + SIZE)[at]
    return (
        np.ascontiguousarray(padded[:, LEFT:]), np.ascontiguousarray(padded[:, LEFT - 1::-1] if LEFT else padded[:, :0]),
        np.minimum(len(data) - at, SIZE), np.minimum(at, LEFT),
    )


def seen_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Anchors whose whole context (inside the text) is that of an earlier anchor of the same text."""
    out = np.zeros(len(at), bool)
    inner = np.flatnonzero((at >= LEFT) & (at + SIZE <= len(data)))
    if len(inner) > 1:
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LEFT + SIZE)[at[inner] - LEFT])
        _, first, back = np.unique(rows.view(f"V{LEFT + SIZE}").ravel(), return_index=True, return_inverse=True)
        out[inner] = first[back.ravel()] != np.arange(len(inner))
    return out


# ---- sorting -----------------------------------------------------------------------------------------

def multikey_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of bytes, and the bytes that each row in order shares with the one before.

    Eight bytes at a time: only rows that are still tied with a neighbour are sorted on."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order, group = np.arange(n), np.zeros(n, np.int64)  # group: of the row at each place of the order
    common = np.full(n, width, np.int64)
    tied = np.arange(n)
    for k in range(words.shape[1]):
        if not len(tied):
            break
        value = words[order[tied], k]
        by = np.lexsort((value, group[tied]))
        order[tied], value = order[tied[by]], value[by]
        same = group[tied[1:]] == group[tied[:-1]]
        new = np.flatnonzero(same & (value[1:] != value[:-1])) + 1
        common[tied[new]] = np.minimum(8 * k + _equal_bytes(value[new], value[new - 1]), width)
        starts = np.concatenate([[True], ~same])
        starts[new] = True
        run = np.cumsum(starts) - 1
        group[tied] = tied[np.flatnonzero(starts)][run]
        size = np.bincount(run)
        tied = tied[size[run] > 1]
    first = np.concatenate([[True], np.zeros(n - 1, bool)]) if n else np.zeros(0, bool)
    common[first] = 0
    return order, common


def _equal_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pairs = (a ^ b).astype(">u8").view(np.uint8).reshape(-1, 8)
    return (pairs != 0).argmax(axis=1)


def found_again(right, left, n_right, n_left, before) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, the bytes that are found earlier to its left and to its right (0 and 0 if no
    string of `SIZE` bytes at it is). `before` gives the order in which suffixes start."""
    n = len(right)
    r_order, r_common = multikey_order(right)
    l_order, l_common = multikey_order(left)
    least, most = np.full(n, SIZE), np.full(n, -1)  # splits at which the string is found again
    rank = np.empty(n, np.int64)
    rank[before] = np.arange(n)
    for a in range(LEFT + 1):
        have = np.flatnonzero((n_left >= a) & (n_right >= SIZE - a))
        if len(have) < 2:
            continue
        r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
        r_class[r_order] = np.cumsum(r_common < SIZE - a)
        l_class[l_order] = np.cumsum(l_common < a)
        key = r_class[have] * (n + 1) + l_class[have]
        by = np.lexsort((rank[have], key))
        again = have[by[1:]][key[by[1:]] == key[by[:-1]]]
        least[again] = np.minimum(least[again], a)
        most[again] = np.maximum(most[again], a)
    some = most >= 0
    return np.where(some, most, 0), np.where(some, SIZE - least, 0)


# ---- rows ------------------------------------------------------------------------------------------

MARK = "h BIGINT, uid BIGINT, times TINYINT"
PLACE = "uid BIGINT, ord BIGINT, pos INT"
SUFFIX = f"{PLACE}, lead BINARY, rest BINARY, back BINARY, lo INT, hi INT, crowd BOOLEAN"
#: How often a key is known to occur: once in its text, more than once, or in several texts.
ONCE, TWICE, KNOWN = 0, 1, 2


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in `known`, which is sorted."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _marks(batch, known):
    out: tuple = ([], [], [])
    # Copies in a batch have the same rows.
    for uid, text in dict(zip(batch["uid"].to_pylist(), batch["text"].to_pylist())).items():
        hashes, times = np.unique(anchors(_bytes(text))[1], return_counts=True)
        for x, v in zip(out, (hashes.view(np.int64), np.full(len(hashes), uid), times > 1)):
            x.append(v)
    h, uid, twice = map(np.concatenate, out)
    return {"h": h, "uid": uid, "times": np.where(_among(h, known), KNOWN, twice).astype(np.int8)}


def _twice(batches):
    """Of rows in order, (uid, h) of keys that occur in another text too, or twice in one."""
    for batch in batches:
        if batch.num_rows:
            h, uid = (batch.column(c).to_numpy() for c in ("h", "uid"))
            same, other = h[1:] == h[:-1], uid[1:] != uid[:-1]
            run = np.concatenate([[0], np.cumsum(~same)])
            mixed = np.bincount(run[1:], same & other, run[-1] + 1) > 0
            mixed[[0, -1]] = True  # may go on across the border
            keep = mixed[run] | (batch.column("times").to_numpy() > ONCE)
            yield pa.RecordBatch.from_arrays([pa.array(uid[keep]), pa.array(h[keep])], names=["uid", "h"])


def _suffixes(batch, splitters, crowded, buckets):
    """The suffixes at a candidate's anchors that other texts may share, each with its bucket, and what is
    known to be found again: ranges (`lo`, `hi`) around anchors whose context occurs before in this batch."""
    import zstandard

    parts: list = []
    unpack = zstandard.ZstdDecompressor().decompress
    by_order = sorted(zip(*(batch[c].to_pylist() for c in ("ord", "uid", "z", "hs"))), key=lambda r: (r[0], r[1]))
    for k, (order, uid, z, hs) in enumerate(by_order):
        data = np.frombuffer(unpack(z), np.uint8)
        at, hashes = anchors(data)
        at = at[np.isin(hashes, np.array(hs, np.int64).view(np.uint64))]
        again = seen_before(data, at)
        right, back, n_right, n_left = contexts(data, at)
        parts.append((np.full(len(at), k), np.full(len(at), uid), np.full(len(at), order), at, again, right, back, n_right, n_left))
    doc, uid, order, at, again, right, back, n_right, n_left = (np.concatenate(x) for x in zip(*parts))
    whole = np.flatnonzero((n_right == SIZE) & (n_left == LEFT))
    if len(whole):
        rows = np.ascontiguousarray(np.concatenate([right[whole], back[whole]], axis=1)).view(f"V{SIZE + LEFT}").ravel()
        _, first, inverse = np.unique(rows, return_index=True, return_inverse=True)
        first = first[inverse.ravel()]
        here = np.arange(len(whole))
        same = (uid[whole][first] == uid[whole]) & (at[whole][first] == at[whole])
        again[whole] |= (first != here) & ~same  # a repeated row is not an earlier string
    # What is settled, as runs of ranges that meet; anchors ascend within a document.
    done = np.flatnonzero(again)
    lo, hi = np.maximum(at[done] - LEFT, 0), at[done] + SIZE
    new = np.flatnonzero(np.concatenate([[True], (doc[done][1:] != doc[done][:-1]) | (lo[1:] > hi[:-1])])[:len(done)])
    last = np.concatenate([new[1:], [len(done)]]).astype(np.int64)[:len(new)] - 1
    runs, open_ = done[new], np.flatnonzero(~again)
    leads = np.ascontiguousarray(right[open_, :KEY]).view(f"S{KEY}").ravel()
    crowd = _among(leads, crowded)
    spread = ((uid[open_] ^ at[open_]).view(np.uint64) * _MIX >> np.uint64(33)).astype(np.int64) % buckets
    bucket = np.where(crowd, spread, np.searchsorted(splitters, leads, side="right"))
    none = [None] * len(runs)
    return {
        "uid": np.concatenate([uid[runs], uid[open_]]), "ord": np.concatenate([order[runs], order[open_]]),
        "pos": np.concatenate([at[runs], at[open_]]).astype(np.int32),
        "lead": none + [r.tobytes() for r in right[open_, :KEY]],
        "rest": none + [r[KEY:n].tobytes() for r, n in zip(right[open_], n_right[open_])],
        "back": none + [r[:n].tobytes() for r, n in zip(back[open_], n_left[open_])],
        "lo": lo[new].tolist() + [None] * len(open_), "hi": hi[last].tolist() + [None] * len(open_),
        "crowd": np.concatenate([np.zeros(len(runs), bool), crowd]),
        "bucket": np.concatenate([uid[runs] % buckets, bucket]).astype(np.int32),
    }


def _matrix(parts: pa.BinaryArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of zero-padded bytes, and their sizes."""
    ends = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset:parts.offset + len(parts) + 1]
    flat, sizes = parts.buffers()[2], np.diff(ends).astype(np.int64)
    out = np.zeros((len(parts), width), np.uint8)
    if flat is not None:
        out[np.arange(width)[None, :] < sizes[:, None]] = np.frombuffer(flat, np.uint8)[ends[0]:ends[-1]]
    return out, sizes


def _starts(lead: pa.BinaryArray) -> np.ndarray:
    """Where runs of equal leading strings start."""
    rows, _ = _matrix(lead, KEY)
    return np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])[:len(rows)])


def _settle(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of suffixes with whole groups of leading bytes: uid, lo, hi of what is found again."""
    uid, order, pos = (rows.column(c).to_numpy().astype(np.int64) for c in ("uid", "ord", "pos"))
    by = np.lexsort((pos, uid, order))
    # A row that is there twice is one place.
    new = np.concatenate([[True], np.any([x[by[1:]] != x[by[:-1]] for x in (uid, order, pos)], axis=0)])
    by = by[new]
    lead, _ = _matrix(rows.column("lead"), KEY)
    rest, n_rest = _matrix(rows.column("rest"), SIZE - KEY)
    back, n_left = _matrix(rows.column("back"), LEFT)
    before, after = found_again(
        np.concatenate([lead, rest], axis=1)[by], back[by], n_rest[by] + KEY, n_left[by], np.arange(len(by))
    )
    some = np.flatnonzero(after)
    at = by[some]
    return uid[at], pos[at] - before[some], pos[at] + after[some]


def _buckets(batches):
    """Sorted suffixes in, ranges found again out; those of a crowded key go on as they are."""
    names = ["uid", "ord", "pos", "lead", "rest", "back", "lo", "hi", "crowd"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]

    def settled(rows: pa.RecordBatch):
        """Of whole groups: ranges found again, and the suffixes of crowds."""
        starts = _starts(rows.column("lead"))
        size = np.diff(np.append(starts, rows.num_rows))
        size = np.repeat(size, size)
        if (size > CROWD).any():
            yield rows.filter(pa.array(size > CROWD))
        rows = rows.filter(pa.array((size > 1) & (size <= CROWD)))
        if rows.num_rows:
            uid, lo, hi = _settle(rows)
            own = {"uid": uid, "lo": lo, "hi": hi, "crowd": np.zeros(len(uid), bool)}
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[c], t) if c in own else pa.nulls(len(uid), t) for c, t in zip(names, types)], names=names
            )

    def together(parts):
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    held: list = []  # rows in order; the last group may go on
    n, most, crowd = 0, AT_ONCE, None  # crowd: the leading string whose suffixes are given out as they come
    for batch in batches:
        batch = batch.select(names)
        passed = batch.column("hi").is_valid().to_numpy(zero_copy_only=False) | batch.column("crowd").to_numpy(zero_copy_only=False)
        if crowd is not None:
            passed |= pa.compute.equal(batch.column("lead"), crowd).fill_null(False).to_numpy(zero_copy_only=False)
        if passed.any():
            yield batch.filter(pa.array(passed))
            batch = batch.filter(pa.array(~passed))
        if not batch.num_rows:
            continue
        crowd = None
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            rows = together(held)
            last = int(_starts(rows.column("lead"))[-1])
            if last:
                yield from settled(rows.slice(0, last))
            rows = rows.slice(last)
            if rows.num_rows > CROWD:
                crowd = rows.column("lead")[0]
                yield rows
                rows = rows.slice(0, 0)
            held, n = [rows] if rows.num_rows else [], rows.num_rows
            most = n + AT_ONCE
    if held:
        yield from settled(together(held))


def _strings(batch):
    """Each string of `SIZE` bytes at a suffix, by a digest, with its place."""
    out: dict = {"string": [], "uid": [], "ord": [], "start": []}
    for uid, order, pos, lead, rest, back in zip(*(batch[c].to_pylist() for c in ("uid", "ord", "pos", "lead", "rest", "back"))):
        around = back[::-1] + lead + rest
        for start in range(len(around) - SIZE + 1):
            if start <= len(back):
                out["string"].append(hashlib.blake2b(around[start:start + SIZE], digest_size=16).digest())
                out["uid"].append(uid)
                out["ord"].append(order)
                out["start"].append(pos - len(back) + start)
    return out


def _crowds(suffixes: DataFrame) -> DataFrame:
    """What is found again of suffixes with crowded keys, by aggregating each of their strings."""
    strings = mapped(suffixes, _strings, "string BINARY, uid BIGINT, ord BIGINT, start INT").distinct()
    place = F.struct("ord", "uid", "start")
    first = strings.groupBy("string").agg(F.min(place).alias("first"))
    again = strings.join(first, "string").where(place != F.col("first"))
    return again.select("uid", F.col("start").alias("lo"), (F.col("start") + SIZE).alias("hi"))


def _kept(batch):
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    out: dict = {"uid": batch["uid"], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
    for z, spans in zip(batch["z"].to_pylist(), batch["spans"].to_pylist()):
        data = np.frombuffer(unpack(z), np.uint8)
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, [s["lo"] for s in spans], 1)
        np.add.at(edge, [s["hi"] for s in spans], -1)
        gone = np.cumsum(edge)[:-1] > 0
        kept = data[~gone].tobytes()
        out["n_removed"].append(int(gone.sum()))
        out["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        out["kept"].append(kept)
    return out


def _every(rows: DataFrame) -> int:
    """One of how many rows is looked at."""
    return max(rows.count() // LOOKED, 1)


def _dealing(candidates: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Splitters between buckets, leading strings of crowds, and the number of buckets, from the
    suffixes of some candidates."""
    every = _every(candidates)
    none = np.zeros(0, f"S{KEY}")
    looked = mapped(
        candidates.where(F.pmod(F.xxhash64("uid"), F.lit(every)) == 0), lambda b: _suffixes(b, none, none, 1), f"{SUFFIX}, bucket INT"
    )
    leads = written(looked.where("lead IS NOT NULL").select("uid", "pos", "lead"), "leads")
    seen = leads.count()
    often = leads.groupBy("lead").count().where((F.col("count") >= SEEN) & (F.col("count") * every > CROWD))
    crowded = np.array(sorted(bytes(r.lead) for r in often.orderBy(F.desc("count"), "lead").limit(TAKEN).collect()), f"S{KEY}")
    some = leads.where(F.pmod(F.xxhash64("uid", "pos"), F.lit(-(-seen // TAKEN) or 1)) == 0)
    some = np.sort(np.array([bytes(r.lead) for r in some.select("lead").collect()], f"S{KEY}"))
    some = some[~_among(some, crowded)]
    wide = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(-(-seen * every // BUCKET), min(wide, seen * every // 5_000), 1)
    buckets = max(min(buckets, len(some) // SEEN), 1)
    return np.unique(some[[len(some) * k // buckets for k in range(1, buckets)]]), crowded, buckets


def deduplicate(docs: DataFrame, kept_bytes: bool = False) -> DataFrame:
    """Per document: `doc_id`, `n_bytes`, `n_removed`, `n_spans` (maximal removed runs) and
    `kept_sha256`; with `kept_bytes` also `kept`, the bytes that are left.

    Strings are judged on the input and never cross documents. Null counts as empty. Documents are
    ordered by `doc_id`, a null one last; different texts with one `doc_id` by their hash; rows with
    the same `doc_id` and text are one document and get the same result. Other columns are ignored; an
    empty table gives no row.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts(docs).select(
        F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("ord"), "doc_id", "text", F.xxhash64("text").alias("uid"),
        F.sha2("text", 256).alias("digest"),
    )
    long = rows.select("ord", "text", "uid").where(F.octet_length("text") >= SIZE)
    marked = lambda some, known: mapped(some, lambda b, k=known: _marks(b, k), MARK)
    looked = F.pmod(F.xxhash64("ord", F.octet_length("text")), F.lit(_every(docs)))
    several = marked(long.where(looked == 0), np.zeros(0, np.int64)).groupBy("h").agg(
        F.min("uid").alias("a"), F.max("uid").alias("b"), F.count("*").alias("n")
    ).where("a < b").orderBy(F.desc("n"), "h").limit(TAKEN)
    marks = marked(long, np.sort(np.array([r.h for r in several.collect()], np.int64)))
    dealt = marks.repartition(F.when(F.col("times") == KNOWN, F.xxhash64("uid", "h")).otherwise(F.col("h"))).sortWithinPartitions("h", "uid")
    keys = written(dealt.mapInArrow(_twice, "uid BIGINT, h BIGINT"), "keys")

    firsts = rows.groupBy("uid", "digest").agg(F.min("ord").alias("first"))
    of_text = keys.groupBy("uid").agg(F.collect_set("h").alias("hs"))
    holders = firsts.drop("digest").join(of_text, "uid")

    def compress(batch):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        return {"ord": batch["ord"], "uid": batch["uid"], "z": [pack(t.encode("utf-8", "replace")) for t in batch["text"].to_pylist()]}

    packed = mapped(rows.where(F.octet_length("text") >= SIZE).select("ord", "uid", "text"), compress, "ord BIGINT, uid BIGINT, z BINARY")
    candidates = written(
        packed.join(holders.hint("shuffle_hash"), "uid").where("ord = first").select("ord", "uid", "z", "hs"), "candidates"
    )
    splitters, crowded, buckets = _dealing(candidates)
    dealt = mapped(candidates, lambda b: _suffixes(b, splitters, crowded, buckets), f"{SUFFIX}, bucket INT")
    suffixes = dealt.repartitionById(buckets, "bucket").drop("bucket").sortWithinPartitions("lead")
    found = written(suffixes.mapInArrow(_buckets, SUFFIX), "found")
    again = found.where("hi IS NOT NULL").select("uid", "lo", "hi").union(_crowds(found.where("hi IS NULL")))
    spans = again.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    cut = mapped(
        candidates.select("uid", "z").join(spans.hint("shuffle_hash"), "uid"), _kept,
        "uid BIGINT, n_removed BIGINT, n_spans BIGINT, kept_sha256 STRING, kept BINARY",
    ).dropDuplicates(["uid"])

    whole = rows.select("doc_id", "ord", "uid", "digest", F.octet_length("text").cast("long").alias("n_bytes"), *(["text"] if kept_bytes else []))
    narrow = whole.join(firsts, ["uid", "digest"]).join(cut if kept_bytes else cut.drop("kept"), "uid", "left")
    copy = (F.col("ord") > F.col("first")) & (F.col("n_bytes") >= SIZE)
    result = narrow.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.coalesce("kept", F.col("text").cast("binary"))).alias("kept")] if kept_bytes else []),
    )
    return result


def op4_substrings(spark, folder: str) -> DataFrame:
    return deduplicate(table(spark, folder, "documents"))
