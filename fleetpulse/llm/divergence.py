"""Source divergence audit: how far the sources of a language lie apart, and by which terms.

1. Each task counts terms by (lang, source) while it reads, so that what is shuffled is one row per
   group and term and task, however large the group. Dealt by (lang, term), a term's rows meet: its
   documents decide whether the language keeps it.
2. *Pairs.* The share of every kept term in one source less that in another, summed. Terms are dealt
   into chunks of at most about `CELLS` (source, term) cells; a chunk is one dense matrix, which gives
   for `BLOCK` sources at a time the sums against all sources. Sums of chunks are added up.
3. *Terms.* A term is dominated by another of its group with at least its group count, at most its
   lang count and an earlier name: whatever the totals are, that one's share differs as much or more,
   and it comes first in a tie. Terms dominated by `top` others can't be among the first `top`. Every
   partition retains the others (its skyband), skybands are merged in two steps, and only what is left
   is ranked exactly.

Shares are computed in decimals, so no count is too large.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.tables import table, written
from fleetpulse.operators.sizing import lookup_join

LEAST_DOCS, TOP = 30, 50
HELD, CELLS, BLOCK, ROWS, FANS = 300_000, 1_000_000, 256, 1024, 16
#: ASCII letters in lower case and all bytes of other characters stay; the rest is a space.
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
COUNTS = "lang STRING, source STRING, term BINARY, n BIGINT, docs BIGINT"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def _counted(batches):
    """Occurrences and documents of each (lang, source, term), given out when over `HELD` are held."""
    held: dict = {}

    def out():
        keys = [(g, t) for g, (n, _) in held.items() for t in n]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([g[0] for g, _ in keys], pa.string()), pa.array([g[1] for g, _ in keys], pa.string()),
                pa.array([t for _, t in keys], pa.binary()), pa.array([held[g][0][t] for g, t in keys], pa.int64()),
                pa.array([held[g][1][t] for g, t in keys], pa.int64()),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            words = terms_of(text)
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            n.update(words)
            docs.update(set(words))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield out()
            held.clear()
    yield out()


def kept_terms(rows: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, c): occurrences of each kept term where there are any, and in all of the lang;
    `first` marks one row of each (lang, term)."""
    counts = rows.mapInArrow(_counted, COUNTS).repartition("lang", "term")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    return counts.select(
        "lang", "source", "term", "n", F.sum("n").over(of_term).alias("c"), F.sum("docs").over(of_term).alias("all_docs"),
        (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"),
    ).where(F.col("all_docs") >= least_docs).drop("all_docs")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), in whole numbers of any size."""
    return F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * (count + 5).cast("decimal(20,0)"), (total + 5 * terms).cast("decimal(20,0)")) + 1


def _groups(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """One row per (lang, source): `n_group`, `n_lang`, `terms` kept by the lang, the place `at` of
    the source among the `sources` of the lang, and `none`, the share of a term it doesn't have."""
    found = rows.select("lang", "source").distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_if("first").alias("terms"))
    all_of = found.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0)
    return all_of.select(
        "*", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("at"),
        F.count("*").over(Window.partitionBy("lang")).alias("sources"),
        F.when(F.col("terms") > 0, share(F.lit(0).cast("bigint"), F.col("n_group"), F.col("terms"))).alias("none"),
    )


def _distances(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Of one chunk of terms: the sums of differences of a block of sources against all sources."""
    groups = groups.sort_by("at")
    names = groups["source"].to_pylist()
    which = terms["term"].combine_chunks().dictionary_encode()
    cells = np.repeat(groups["none"].to_numpy()[:, None], len(which.dictionary), axis=1)
    cells[terms["at"].to_numpy(), which.indices.to_numpy()] = terms["p"].to_numpy()
    first = groups["block"][0].as_py() * BLOCK
    mine = range(first, min(first + BLOCK, len(names)))
    sums = [np.abs(cells - cells[a]).sum(axis=1) for a in mine]
    pairs = [(a, b) for a in mine for b in range(len(names)) if a != b]
    return pa.table({
        "lang": pa.array([groups["lang"][0].as_py()] * len(pairs), pa.string()), "source": pa.array([names[a] for a, _ in pairs], pa.string()),
        "item": pa.array([names[b] for _, b in pairs], pa.string()),
        "value": pa.array([int(sums[a - first][b]) for a, b in pairs], pa.int64()),
    })


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): each ordered pair of sources of a lang and the sum of differences."""
    chunks = F.greatest(F.ceil(F.col("terms") * F.col("sources") / CELLS), F.lit(1))
    groups = groups.select(
        "lang", "source", "at", "n_group", "terms", F.coalesce("none", F.lit(0)).alias("none"), chunks.alias("chunks"),
        F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / BLOCK)).alias("blocks"),
    )
    shares = lookup_join(kept, groups, ["lang", "source"])
    cells = shares.select(
        "lang", F.pmod(F.xxhash64("term"), "chunks").alias("chunk"), F.explode("blocks").alias("block"), "at", "term",
        share(F.col("n"), F.col("n_group"), F.col("terms")).alias("p"),
    )
    sides = groups.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select(
        "lang", "chunk", F.explode("blocks").alias("block"), "at", "source", "none"
    )
    key = "lang", "chunk", "block"
    sums = cells.groupBy(*key).cogroup(sides.groupBy(*key)).applyInArrow(
        _distances, "lang STRING, source STRING, item STRING, value BIGINT"
    )
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def survivors(held: tuple[np.ndarray, list], c: np.ndarray, terms: list[bytes], k: int) -> np.ndarray:
    """Which of some terms, in order, fewer than `k` of the held ones and of those before them dominate."""
    held_c, held_terms = held
    every = held_terms + terms
    rank = np.empty(len(every), np.int64)
    rank[sorted(range(len(every)), key=every.__getitem__)] = np.arange(len(every))
    mine = rank[len(held_terms):]
    over = ((c[None, :] <= c[:, None]) & (mine[None, :] < mine[:, None]) & np.tri(len(c), k=-1, dtype=bool)).sum(axis=1)
    for i in range(0, len(held_terms), 8 * ROWS):
        part = slice(i, i + 8 * ROWS)
        over += ((held_c[None, part] <= c[:, None]) & (rank[None, :len(held_terms)][:, part] < mine[:, None])).sum(axis=1)
    return over < k


def _band(k: int):
    """Keeps the skyband of each group; groups come together, terms by falling n, then c, then name."""

    def run(batches):
        group, held = None, (np.zeros(0, np.int64), [])
        for batch in batches:
            keys = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            c, terms = batch.column("c").to_numpy(), batch.column("term").to_pylist()
            keep = np.zeros(len(keys), bool)
            start = 0
            while start < len(keys):
                if keys[start] != group:
                    group, held = keys[start], (np.zeros(0, np.int64), [])
                end = start + 1
                while end < len(keys) and end - start < ROWS and keys[end] == group:
                    end += 1
                good = survivors(held, c[start:end], terms[start:end], k)
                keep[start:end] = good
                held = (np.concatenate([held[0], c[start:end][good]]), held[1] + [t for t, g in zip(terms[start:end], good) if g])
                start = end
            yield batch.filter(pa.array(keep))

    return run


def skyband(terms: DataFrame, k: int) -> DataFrame:
    """The rows (lang, source, term, n, c) that fewer than `k` others of their group dominate."""
    terms = terms.select("lang", "source", "term", "n", "c")
    order = "lang", "source", F.desc("n"), "c", "term"
    ddl = "lang STRING, source STRING, term BINARY, n BIGINT, c BIGINT"
    each = terms.sortWithinPartitions(*order).mapInArrow(_band(k), ddl)
    some = each.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(FANS)))
    some = some.sortWithinPartitions(*order).mapInArrow(_band(k), ddl)
    return some.repartition("lang", "source").sortWithinPartitions(*order).mapInArrow(_band(k), ddl)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """`lang`, `source`, `part` ('pair' or 'term'), `item`, `value` and `rank` of the audit.

    Null `lang`, `source` and `text` are empty ones. Every row is a document, repeated or not, with or
    without a `doc_id`; other columns are ignored. A group without terms still has its pairs; a lang
    of one source has none. An empty table gives no row. Equal values rank by name in UTF-8 order.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), text.alias("text"))
    kept = written(kept_terms(rows, least_docs), "kept-terms")
    groups = written(_groups(rows, kept), "groups")
    pairs = source_pairs(kept, groups).withColumn("part", F.lit("pair"))
    told = lookup_join(skyband(kept, top), groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("n_group"), F.col("terms")), share(F.col("c"), F.col("n_lang"), F.col("terms"))
    told = told.select("lang", "source", F.col("term").cast("string").alias("item"), (p - q).alias("value")).where("value > 0")
    best = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(told.withColumn("part", F.lit("term"))).withColumn("rank", F.row_number().over(best))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark, folder: str) -> DataFrame:
    return divergence(table(spark, folder, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHARE = "1 + (1000000000::HUGEINT * ({0} + 5)) // ({1} + 5 * terms)"
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= {LEAST_DOCS}),
counts AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT DISTINCT lang, source FROM d),
langs AS (SELECT lang, count(*) AS terms, sum(c) AS n_lang FROM kept GROUP BY lang),
cells AS (
  SELECT *, {_SHARE.format("n", "sum(n) OVER (PARTITION BY lang, source)")} AS p, {_SHARE.format("c", "n_lang")} AS q
  FROM (SELECT lang, source, term, coalesce(n, 0) AS n, c, terms, n_lang
    FROM grp JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term))),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
WHERE part = 'pair' OR rank <= {TOP}"""
