"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Documents and items are normalised alike, character by character, so offsets in the normalised text
are offsets in the original. Every run of `words` consecutive words of an item is a pattern; the
automaton finds all of them in one scan of a document. It reads word numbers, written as two symbols
each (a state looks through its next symbols one by one, so they must not be as many as there are words):
a pattern has at most 2 x `words` states, and an automaton is bounded by the words of its items: those of a set beyond `BLOCK_WORDS` are dealt to blocks (a long item in pieces that share
`words` - 1 words), each block is scanned by itself and writes only the texts with hits, and a last
scan puts the hits of all blocks together.
"""

import math
import uuid
from functools import reduce
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.tables import hex_digest, mapped, table, texts, written
from fleetpulse.operators.sizing import lookup_join

WORDS = 13
#: Most words of the items of one automaton, which takes about 1.5 KB a word while it is built.
BLOCK_WORDS = 100_000
#: Most words of a piece of an item, beyond which a block is more uneven.
PIECE = 4096
#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest is a space.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_AUTOMATA: dict = {}
FOUND = "doc_id BIGINT, n_words BIGINT, n_hit BIGINT, items ARRAY<BIGINT>, spans ARRAY<STRUCT<start: INT, end: INT>>"
HITS = "digest STRING, hits ARRAY<STRUCT<first: INT, after: INT>>, items ARRAY<BIGINT>"


def normalised(text: str) -> str:
    return text.encode("utf-8", "replace").translate(_KEEP).decode("utf-8")


def words_of(text: str) -> list[str]:
    return [w for w in normalised(text).split(" ") if w]


def automaton(key: str, pieces: list[tuple[int, str]], size: int):
    """The symbols of the words, and the automaton; a pattern's value is its number of words and its items.

    `pieces` are of one block, named by `key`; the last block's automaton is kept for further batches."""
    import ahocorasick

    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        symbols = _symbols(pieces)
        owners: dict[str, tuple] = {}
        for item, text in pieces:
            line = "".join(map(symbols.get, text.split(" ")))
            for i in range(0, max(len(line) - 2 * size, 0) + 1, 2):
                window = line[i:i + 2 * size]
                ids = owners.setdefault(window, ())
                if not ids or ids[-1] != item:  # equal items follow each other
                    owners[window] = (*ids, item)
        found = ahocorasick.Automaton()
        while owners:
            window, ids = owners.popitem()
            found.add_word(window, (len(window) // 2, ids))
        found.make_automaton()
        _AUTOMATA[key] = symbols, found
    return _AUTOMATA[key]


def _symbols(pieces: list[tuple[int, str]]) -> dict[str, str]:
    """Two symbols for each word, of two alphabets, so that no match begins inside a word."""
    words = sorted({w for _, text in pieces for w in text.split(" ")})
    base = math.isqrt(len(words)) + 1
    return {w: chr(1 + n // base) + chr(1 + base + n % base) for n, w in enumerate(words)}


def scan(words: list[str], known: tuple | None) -> tuple[list[tuple[int, int]], set]:
    """Word ranges [first, after) that patterns cover, merged, and the items that occur."""
    if known is None:
        return [], set()
    symbols, found = known
    ranges, items = [], set()
    for last, (n, ids) in found.iter("".join(map(symbols.get, words, repeat("\0\0")))):
        after = (last + 1) // 2
        ranges.append((after - n, after))
        items.update(ids)
    return merged(ranges), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, after in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], after)
        else:
            out.append([first, after])
    return [tuple(x) for x in out]


def _pieces(items: DataFrame, size: int) -> DataFrame:
    """Pieces of the items, `item`, `words` (normalised, with one space between) and their number `n`: each
    window is whole in a piece."""

    def cut(batch):
        out: dict = {"item": [], "words": [], "n": []}
        for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
            words = words_of(text)
            longest = max(PIECE, 2 * size)
            for i in range(0, max(len(words) - size, 0) + 1 if words else 0, longest - size + 1):
                part = words[i:i + longest]
                for c, v in zip(out, (item, " ".join(part), len(part))):
                    out[c].append(v)
        return out

    items = items.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return mapped(items, cut, "item BIGINT, words STRING, n BIGINT").distinct()


def blocks(items: DataFrame, size: int = WORDS):
    """The items' pieces in lists of at most `BLOCK_WORDS` words, gathered one part of the table at a time."""
    pieces = written(_pieces(items, size), "pieces")
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = 1 if total <= BLOCK_WORDS else -(-2 * total // BLOCK_WORDS)
    for part in range(parts):
        block, words = [], 0
        for r in sorted(pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part).collect()):
            if block and words + r.n > BLOCK_WORDS:
                yield block
                block, words = [], 0
            block.append((r.item, r.words))
            words += r.n
        if block:
            yield block


def contamination(docs: DataFrame, items: DataFrame, size: int = WORDS, keep_text: bool = False) -> DataFrame:
    """Per document: `doc_id`, `n_words`, `n_hit` words inside an occurrence of a window, `items` that
    occur, and `spans`, the hit ranges [start, end) in code points of the original text; with
    `keep_text` also `text`.

    Null text has no words, and a document without words has no hits. A null item id is -1; items
    without words match nothing; equal items are reported each. Rows with a null or repeated
    `doc_id` are each scanned; other columns are ignored; an empty table of items gives no hits.
    """
    sc = docs.sparkSession.sparkContext
    of_text = texts(docs)
    ahead = blocks(items, size)
    block, after = next(ahead, None), next(ahead, None)
    if after is None:
        return _told(of_text, size, block and sc.broadcast((uuid.uuid4().hex, block)), keep_text)
    of_text = of_text.withColumn("digest", F.sha2("text", 256))
    parts = []
    while block:
        shared = sc.broadcast((uuid.uuid4().hex, block))
        parts.append(written(_hits(of_text, size, shared), "hits"))
        shared.unpersist()
        block, after = after, next(ahead, None)
    rows = reduce(DataFrame.unionByName, parts).groupBy("digest").agg(
        F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    return _told(lookup_join(of_text, rows, "digest", "left").drop("digest"), size, None, keep_text)


def _hits(of_text: DataFrame, size: int, shared) -> DataFrame:
    """The hits of one block in each text that has some, equal texts once."""

    def find(batch):
        known = automaton(*shared.value, size)
        out: dict = {"digest": [], "hits": [], "items": []}
        for digest, text in zip(batch["digest"].to_pylist(), batch["text"].to_pylist()):
            hits, ids = scan(words_of(text), known)
            if hits:
                for c, v in zip(out, (digest, [{"first": a, "after": b} for a, b in hits], sorted(ids))):
                    out[c].append(v)
        return out

    return mapped(of_text.select("digest", "text"), find, HITS).dropDuplicates(["digest"])


def _told(of_text: DataFrame, size: int, shared, keep_text: bool) -> DataFrame:
    """What is told of each document, from the automaton of the only block, or from the columns `hits` and `items`."""

    def find(batch):
        known = automaton(*shared.value, size) if shared else None
        out = {c: [] for c in ("n_words", "n_hit", "items", "spans")} | {c: batch[c] for c in ("doc_id", "text")}
        none = repeat(None)
        given = [batch[c].to_pylist() if c in batch else none for c in ("hits", "items")]
        for text, hits, ids in zip(batch["text"].to_pylist(), *given):
            plain = normalised(text)
            words = [w for w in plain.split(" ") if w]
            here, some = scan(words, known)
            if hits:
                here, some = merged([(h["first"], h["after"]) for h in hits]), ids
            out["n_words"].append(len(words))
            out["n_hit"].append(sum(b - a for a, b in here))
            out["items"].append(sorted(some))
            out["spans"].append(_spans(plain, words, here) if here else [])
        return out

    return mapped(of_text, find, FOUND + ", text STRING" * keep_text)


def _spans(plain: str, words: list[str], hits: list[tuple[int, int]]) -> list[dict]:
    starts, at = [], 0
    for w in words:
        at = plain.index(w, at)
        starts.append(at)
        at += len(w)
    return [{"start": starts[a], "end": starts[b - 1] + len(words[b - 1])} for a, b in hits]


def contaminated() -> Column:
    """A document is contaminated if at least a twentieth of its words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def keep_clean(docs: DataFrame, items: DataFrame, size: int = WORDS) -> DataFrame:
    """The rows of `docs` that are not contaminated, with all their columns.

    Rows with the same text have the same verdict, so they are found again by a digest of it."""
    digest = lambda c: F.sha2(F.coalesce(F.col(c), F.lit("")), 256)
    distinct = docs.select(F.lit(None).cast("long").alias("doc_id"), "text")
    found = contamination(distinct, items, size, keep_text=True).where(contaminated())
    bad = written(found.select(digest("text").alias("digest")).distinct(), "contaminated")
    return docs.alias("d").join(bad.hint("shuffle_hash").alias("b"), digest("d.text") == F.col("b.digest"), "left_anti")


def op6_decontamination(spark, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        hex_digest(F.array_join(ids, ",")).alias("items_sha256"), contaminated().alias("contaminated"),
    )


_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PATTERN}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_PATTERN}') AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(len(w), {WORDS}) AS n, array_to_string(w[i:i + least(len(w), {WORDS}) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WORDS}, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM pat),
win AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, size)),
hit AS (SELECT doc_id, i, win.n, item_id FROM win JOIN pat USING (n, p)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
