"""Merkle manifest of a dataset, with a proof for every document.

A document is a leaf; the leaves of a source, in the order of `doc_id`, are the lowest level of a tree
of which every `FAN` consecutive nodes have one parent; the roots of the sources are in turn the leaves
of the tree of the whole set. All nodes of a level rise together, so a tree's height follows from
the number of its leaves.

Trees are built in tiers. In a tier each aligned block of `FAN` ** `LEVELS` nodes of a tree keeps each of
its levels as one string of hex digests, `WIDTH` characters each: substrings of `FAN` * `WIDTH` are what
parents hash, and what flanks a node in such a substring are its siblings. The nodes on top of the
blocks are the next tier. On the way down, each block's row hands to the blocks below it the siblings of
their top nodes, so that a leaf's proof is what its own block has and what its block was handed.

Places in a source are counted without gathering it: leaves are range-partitioned by source and order,
and a table of (partition, source) counts gives each partition's first place.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.tables import hex_digest, table, written
from fleetpulse.operators.sizing import lookup_join

FAN, LEVELS, WIDTH = 16, 2, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(**changed: Column) -> Column:
    """The digest of a document's fields, some of them put in place of its own."""
    return hex_digest(F.concat(*[field(changed.get(c, F.col(c))) for c in FIELDS]))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: hex_digest(F.concat(s["left"], node, s["right"])))


def proof_of(path: Column) -> Column:
    return hex_digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / (FAN * WIDTH)).cast("int"))
    return F.array_join(F.transform(runs, lambda j: hex_digest(F.substring(level, j * FAN * WIDTH + 1, F.lit(FAN * WIDTH)))), "")


def _siblings(level: Column, at: Column) -> Column:
    run = F.substring(level, F.floor(at / FAN).cast("int") * FAN * WIDTH + 1, F.lit(FAN * WIDTH))
    before = (at % FAN) * WIDTH
    return F.struct(
        F.substring(run, F.lit(1), before).alias("left"), F.substring(run, before + WIDTH + 1, F.lit(FAN * WIDTH)).alias("right")
    )


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` of a written table with `at`, the place of each in its `tree`, and `leaves` of the tree."""
    rows = rows.withColumn("salt", F.monotonically_increasing_id())  # so that equal rows can be parted
    keys = "tree", *order, "salt"
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("salt")
    ordered = written(ordered.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.shiftright("row", 33)), "placed")
    counts = ordered.groupBy("part", "tree").agg(F.min("row").alias("start"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    earlier = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", "tree", (F.col("start") - earlier).alias("start"), F.sum("n").over(tree).alias("leaves"))
    return lookup_join(ordered, starts, ["part", "tree"]).withColumn("at", F.col("row") - F.col("start")).drop("row", "part", "start")


def _blocks(nodes: DataFrame, tier: int) -> DataFrame:
    """(`tree`, `block`, `leaves`, `members`, `l0`, `l1`, `used`, `top`) of the nodes (`tree`, `at`, `leaves`, `node`,
    `carried`) of a tier; `used` is how many levels rise inside the block."""
    size = FAN**LEVELS
    rows = nodes.groupBy("tree", F.floor(F.col("at") / size).alias("block")).agg(
        F.first("leaves").alias("leaves"), F.array_sort(F.collect_list(F.struct("at", "node", "carried"))).alias("members")
    )
    # Sums of 0 and 1 stay exact where a logarithm is not.
    height = reduce(lambda a, b: a + b, [(F.col("leaves") > FAN**i).cast("int") for i in range(15)])
    used = F.least(F.greatest(height - tier * LEVELS, F.lit(0)), F.lit(LEVELS))
    rows = rows.select("*", used.alias("used"), F.array_join(F.transform("members", lambda m: m["node"]), "").alias("l0"))
    rows = rows.withColumn("l1", F.when(F.col("used") >= 1, _parents(F.col("l0"))))
    top = F.when(F.col("used") == 2, _parents(F.col("l1"))).when(F.col("used") == 1, F.col("l1")).otherwise(F.col("l0"))
    return rows.withColumn("top", top)


def grown(nodes: DataFrame) -> list[DataFrame]:
    """The tiers of the trees of `nodes` (`tree`, `at`, `leaves`, `node`, `carried`), lowest first; the blocks
    of the last one are whole trees."""
    tiers: list[DataFrame] = []
    most = nodes.agg(F.max("leaves")).first()[0] or 0
    while not tiers or most > FAN ** (LEVELS * len(tiers)):
        tiers.append(written(_blocks(nodes, len(tiers)), "blocks"))
        nodes = tiers[-1].select(
            "tree", F.col("block").alias("at"), "leaves", F.col("top").alias("node"), F.lit(None).cast("string").alias("carried")
        )
    return tiers


def paths(tiers: list[DataFrame], above: DataFrame, *more: str) -> DataFrame:
    """(`tree`, `at`, `node`, `carried`, `path`, `more`...) of the nodes of the lowest tier, from the path `above`
    each tree (`tree`, `path`, `more`...)."""
    above = above.withColumn("block", F.lit(0).cast("bigint"))
    for blocks in reversed(tiers):
        rows = blocks.join(above, ["tree", "block"]).select("tree", "l0", "l1", "used", "path", *more, F.posexplode("members").alias("i", "member"))
        own = F.concat(
            F.when(F.col("used") >= 1, F.array(_siblings(F.col("l0"), F.col("i")))).otherwise(F.array().cast(PATH)),
            F.when(F.col("used") >= 2, F.array(_siblings(F.col("l1"), F.floor(F.col("i") / FAN).cast("int")))).otherwise(F.array().cast(PATH)),
        )
        rows = rows.select("tree", "member.*", F.concat(own, "path").alias("path"), *more)
        above = rows.select("tree", F.col("at").alias("block"), "path", *more)
    return rows


def manifest(docs: DataFrame) -> DataFrame:
    """Per document: `doc_id`, `leaf`, `changed` (the leaf after the tampering of `op12_manifest`, null if there
    is none), `subroot`, `root` and `path`, its siblings from the leaf up.

    Null fields are `-` in a leaf; null sources are one tree, the first; null ids come first in their
    tree. Rows with one `doc_id` are ordered by leaf; repeated rows are leaves each. A tree of one
    leaf is that leaf. Other columns are ignored; an empty table gives no row.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    changed = F.when(hit & F.col("text").isNotNull(), leaf_of(text=F.translate("text", UPPER, LOWER))).when(hit, leaf_of())
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source")))  # sorts null first
    leaves = written(docs.select("doc_id", tree.alias("tree"), leaf_of().alias("node"), changed.alias("changed")), "leaves")
    leaves = placed(leaves, "doc_id", "node")
    of_source = grown(leaves.select("tree", "at", "leaves", "node", F.struct("doc_id", "changed").alias("carried")))
    subroots = of_source[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("node"))
    subroots = placed(written(subroots, "subroots"), "name")
    of_all = grown(subroots.select("tree", "at", "leaves", "node", F.col("name").alias("carried")))
    root = of_all[-1].select("tree", F.array().cast(PATH).alias("path"), F.col("top").alias("root"))
    above = paths(of_all, root, "root").select(F.col("carried").alias("tree"), "path", F.col("node").alias("subroot"), "root")
    return paths(of_source, written(above, "subroot-paths"), "subroot", "root").select(
        "carried.doc_id", F.col("node").alias("leaf"), "carried.changed", "subroot", "root", "path"
    )


def op12_manifest(spark, folder: str) -> DataFrame:
    rows = manifest(table(spark, folder, "documents"))
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof_of(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int = 5) -> str:
    """SQL with as many levels spelt out as 16 ** `levels` leaves of a source need, and for the sources."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    text = f"CASE WHEN hit THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    head = " || ".join(part(c) for c in FIELDS[:-1])
    # The bits of CRC-32: a byte is put in, or (256) the register goes one bit down.
    bits = (
        "list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), 256, 256, 256, 256, 256, 256, 256, 256])), "
        "lambda a, x: CASE WHEN x < 256 THEN xor(a, CAST(x AS BIGINT)) ELSE xor(a >> 1, (a & 1) * 3988292384) END, CAST(4294967295 AS BIGINT))"
    )
    steps = []
    for name, start in (("s", "SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, id AS member, leaf AS node FROM leaves"),
                        ("r", f"SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, tree AS member, node FROM s{levels} WHERE pos = 0")):
        steps.append(f"{name}0 AS ({start})")
        for k in range(levels):
            # A tree of one node is done: it goes up unchanged, without siblings.
            steps.append(
                f"{name}{k + 1} AS (SELECT tree, pos // 16 AS pos, CASE WHEN any_value(n) = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node, "
                f"any_value(n) > 1 AS used, list(node ORDER BY pos) AS run FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}{k}) GROUP BY tree, pos // 16)"
            )
    def path(name: str) -> tuple[str, str]:
        joins = " ".join(
            f"JOIN {name}{k + 1} p{k} ON p{k}.tree IS NOT DISTINCT FROM m.tree AND p{k}.pos = m.pos // {16 ** (k + 1)}" for k in range(levels)
        )
        sides = ", ".join(
            f"CASE WHEN p{k}.used THEN {{'l': array_to_string(p{k}.run[1:(m.pos // {16 ** k}) % 16], ''), 'r': array_to_string(p{k}.run[(m.pos // {16 ** k}) % 16 + 2:], '')}} END"
            for k in range(levels)
        )
        return f"FROM {name}0 m {joins}", f"list_filter([{sides}], lambda x: x IS NOT NULL)"

    (s_from, s_path), (r_from, r_path) = path("s"), path("r")
    return f"""
WITH rows AS (SELECT *, row_number() OVER () AS id, doc_id IS NOT NULL AND xor({bits}, 4294967295) % 5 = 0 AS hit FROM documents),
leaves AS (SELECT id, doc_id, source, sha256({head} || {part("text")}) AS leaf, sha256({head} || {part("(" + text + ")")}) AS changed FROM rows),
{", ".join(steps)},
up AS (SELECT m.member AS tree, m.node AS subroot, p{levels - 1}.node AS root, {r_path} AS path {r_from}),
down AS (SELECT m.tree, m.member AS id, {s_path} AS path {s_from}),
found AS (
  SELECT l.*, u.subroot, u.root, list_concat(d.path, u.path) AS path
  FROM leaves l JOIN down d USING (id) JOIN up u ON u.tree IS NOT DISTINCT FROM d.tree)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256,
  list_reduce(list_prepend({{'l': changed, 'r': ''}}, path), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root,
  folded_root = root AS verified
FROM found"""


SQL = _sql()
