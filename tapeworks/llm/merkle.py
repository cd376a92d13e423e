"""Merkle manifest of a table, with proofs by coordinate look-up.

1. Each row is a leaf, the SHA-256 of its fields. Leaves are put in order within their tree by range partitions: places within a
   partition, and running totals of the partitions' counts, a row each. So a tree of any share of the rows is spread out.
2. Level by level, every `FAN` nodes in a row become one, up to a single node; each level is written. The tree's tops, in the
   order of their names, are the leaves of one more tree.
3. Proofs, from the top down: a node's place and its level's size give the coordinates of its siblings; they are
   exploded, joined with the written nodes of that level, put in order and concatenated, and the parent's path follows. A
   coordinate is looked up by the `FAN` - 1 nodes of its run and a path taken over by `FAN` children, so no key is hot. Nodes and
   look-ups are both dealt out by run, so joining and ordering shuffle no exploded row.
4. A leaf folds up its path to a root by hashing each level's siblings around it.

Digests are kept as 32 bytes and hashed as hex text. Work and tables grow with the rows (1 / 15 more nodes than leaves); the
driver holds the number of levels and the root.

A null field is `-`; a null tree is a tree of its own, before all others. Rows without a doc_id come first in their tree; of rows of
one doc_id the one of the least leaf; equal rows are leaves of their own. An empty table has no root and gives an empty table;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tapeworks.llm.common import table, written

FAN, SHIFT = 16, 4
#: Rows of a range partition, about, while there are fewer of these than twice the shuffle partitions.
PART = 20_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def hexed(c: Column) -> Column:
    return F.lower(F.hex(c))


def field(c: Column) -> Column:
    """A value with its length in bytes before it; `-` if null."""
    v = c.cast("string")
    return F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


def size_at(level: int) -> Column:
    """Nodes of a tree of n leaves at a level."""
    return F.shiftright(F.col("n") + ((1 << SHIFT * level) - 1), SHIFT * level)


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with idx, their place in their tree, and n, the rows of that tree; written. rows are small (no texts) and read twice."""
    partitions = max(1, min(2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // PART))
    ranged = written(rows.repartitionByRange(partitions, "tree", *order).withColumn("part", F.spark_partition_id()))
    of = Window.partitionBy("tree")  # a row for each part that the tree has rows in
    before = of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("c"))
    starts = counts.select("tree", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(of).alias("n"))
    place = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1
    out = ranged.withColumn("place", place.cast("long")).join(starts, ["tree", "part"]).withColumn("idx", F.col("place") + F.col("start"))
    return written(out.drop("part", "place", "start"))


def grown(leaves: DataFrame) -> list[DataFrame]:
    """Levels (tree, n, idx, hash) from leaves up; a tree ends at the level where it has one node."""
    levels = [leaves]
    size = leaves.agg(F.max("n")).first()[0] or 0
    while size > 1:
        k = len(levels) - 1
        run = levels[-1].where(size_at(k) > 1).groupBy("tree", "n", F.shiftright("idx", SHIFT).alias("run")).agg(F.array_sort(F.collect_list(F.struct("idx", "hash"))).alias("nodes"))
        text = F.array_join(F.transform("nodes", lambda x: hexed(x["hash"])), "")
        levels.append(written(run.select("tree", "n", F.col("run").alias("idx"), F.unhex(F.sha2(text, 256)).alias("hash"))))
        size = -(-size // FAN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """tree, n, hash of the single node that each tree ends with."""
    out = None
    for k, level in enumerate(levels):
        last = level.where(size_at(k) == 1).select("tree", "n", "hash")
        out = last if out is None else out.unionByName(last)
    return out


PATH = "array<struct<before:binary,after:binary>>"


def in_run(left: DataFrame, right: DataFrame, how: str, a: str, b: str) -> DataFrame:
    """A join of rows that are dealt out by (tree, run) already, column a of left being column b of right. Were a and b keys of the
    join, both sides would be shuffled anew by them, path and all; so they are compared within the run, of FAN nodes."""
    right = right.withColumnsRenamed({"tree": "_tree", "run": "_run"})
    keys = (F.col("tree") == F.col("_tree")) & (F.col("run") == F.col("_run"))
    return left.join(right, keys & (F.col(a) - F.col(b) == 0), how).drop("_tree", "_run")


def siblings(level: DataFrame, k: int) -> DataFrame:
    """tree, run, idx and the step (digests before and after) of each node that has a parent."""
    nodes = level.where(size_at(k) > 1).withColumn("run", F.shiftright("idx", SHIFT))
    first = F.col("run") * FAN
    others = F.filter(F.sequence(first, F.least(first + (FAN - 1), size_at(k) - 1)), lambda x: x != F.col("idx"))
    wanted = nodes.select("tree", "run", "n", "idx").repartition("tree", "run").select("tree", "run", "idx", F.explode_outer(others).alias("sibling"))
    there = nodes.select("tree", "run", F.col("idx").alias("at"), "hash").repartition("tree", "run")
    got = in_run(wanted, there, "left", "sibling", "at")
    run = got.groupBy("tree", "run", "idx").agg(F.array_sort(F.collect_list(F.when(F.col("sibling").isNotNull(), F.struct("sibling", "hash")))).alias("s"))

    def joined(keep) -> Column:
        return F.unhex(F.array_join(F.transform(F.filter("s", keep), lambda x: F.hex(x["hash"])), ""))

    step = F.struct(joined(lambda x: x["sibling"] < F.col("idx")).alias("before"), joined(lambda x: x["sibling"] > F.col("idx")).alias("after"))
    return run.select("tree", "run", "idx", step.alias("step"))


def steps(levels: list[DataFrame], k: int, above: DataFrame) -> DataFrame:
    """tree, run, idx, top, path of the nodes of a level that have a parent, from the paths of the level above."""
    parents = above.select("tree", F.col("idx").alias("run"), "top", "path").repartition("tree", "run")
    found = siblings(levels[k], k).join(parents, ["tree", "run"])
    return found.select("tree", "run", "idx", "top", F.concat(F.array("step"), F.col("path")).cast(PATH).alias("path"))


def paths(levels: list[DataFrame], start: DataFrame, down_to: int) -> DataFrame | None:
    """tree, idx, top, path of each node of a level: its steps up to its tree's top, and then what `start` (tree, n, top, path)
    has. None above the highest level."""
    above = None
    for k in range(len(levels) - 1, down_to - 1, -1):
        own = start.where((size_at(k) == 1) & ((size_at(k - 1) > 1) if k else F.lit(True))).select("tree", F.lit(0).cast("long").alias("idx"), "top", "path")
        above = written(own if above is None else own.unionByName(steps(levels, k, above).drop("run")))
    return above


@dataclass
class Manifest:
    """leaves (tree, n, idx, hash and what was asked for besides), the levels above them, those of the tree of tops, the root."""

    leaves: DataFrame
    levels: list[DataFrame]
    names: DataFrame
    over: list[DataFrame]
    root: str | None


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, tree: str = "source", order: str = "doc_id", more: dict[str, Column] | None = None) -> Manifest:
    """Trees of the rows of docs by `tree`, in the order of `order`. more: columns to keep beside each leaf."""
    more = {"doc_id": F.col(order)} | (more or {})
    name = F.when(F.col(tree).isNull(), "").otherwise(F.concat(F.lit("="), F.col(tree).cast("string")))
    rows = written(docs.select(name.alias("tree"), leaf([F.col(c) for c in columns]).alias("hash"), *[c.alias(k) for k, c in more.items()], F.monotonically_increasing_id().alias("row")))
    leaves = placed(rows, ["doc_id", "hash", "row"])
    levels = grown(leaves.select("tree", "n", "idx", "hash"))
    names = placed(written(tops(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("n").alias("leaves"), "hash")), ["name"])
    over = grown(names.select("tree", "n", "idx", "hash"))
    root = tops(over).select(hexed(F.col("hash"))).first()
    return Manifest(leaves, levels, names, over, root[0] if root else None)


def proofs(m: Manifest) -> DataFrame:
    """Each leaf's row with top (its tree's digest) and path: for each level up to the root, the digests before and after."""
    last = tops(m.over).select("tree", "n", F.col("hash").alias("top"), F.array().cast(PATH).alias("path"))
    of = paths(m.over, last, 0).select("idx", "path")
    start = written(m.names.join(of, "idx").select(F.col("name").alias("tree"), F.col("leaves").alias("n"), F.col("hash").alias("top"), "path"))
    out = m.leaves.where("n = 1").drop("row", "idx").join(start.where("n = 1").drop("n"), "tree")
    above = paths(m.levels, start, 1)
    if above is None:
        return out
    leaves = m.leaves.where("n > 1").withColumn("run", F.shiftright("idx", SHIFT)).withColumnRenamed("idx", "place").drop("row").repartition("tree", "run")
    return in_run(leaves, steps(m.levels, 0, above), "inner", "place", "idx").drop("run", "place", "idx").unionByName(out)


def fold(start: Column, path: Column) -> Column:
    """The root (hex) that a leaf (hex) and its path give."""
    return F.aggregate(path, start, lambda acc, x: F.sha2(F.concat(hexed(x["before"]), acc, hexed(x["after"])), 256))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf(changed))
    m = manifest(docs, more={"tampered": tampered})
    root = F.lit(m.root).cast("string")
    folded = fold(hexed(F.coalesce("tampered", "hash")), F.col("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: hexed(F.concat(x["before"], x["after"]))), ""), 256)
    out = proofs(m).select("doc_id", hexed(F.col("hash")).alias("leaf"), hexed(F.col("top")).alias("subroot"), root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels that the SQL goes up: enough for trees of 16 ** DEPTH leaves.
DEPTH = 5


def _levels(name: str, by: str, leaves: str) -> str:
    """CTEs of a tree's levels (name0 ... nameDEPTH: by, i, m nodes of the level, h) and of each leaf's strings of siblings."""
    out = [f"{name}0 AS MATERIALIZED ({leaves})"]
    for k in range(DEPTH):
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {by}, i // 16 AS i, (any_value(m) + 15) // 16 AS m, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY {by}, i // 16)")
        w = f"(PARTITION BY {by}, i // 16 ORDER BY i ROWS BETWEEN"
        out.append(f"{name}s{k} AS MATERIALIZED (SELECT {by}, i, m, coalesce(string_agg(h, '') OVER {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(h, '') OVER {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name}{k})")
    return ",\n".join(out)


def _text(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"


def _sql() -> str:
    rest = [_text(c) for c in COLUMNS[:-1]]
    crc = "xor(list_reduce(list_concat([4294967295], [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295)"
    steps = [("s", k) for k in range(DEPTH)] + [("r", k) for k in range(DEPTH)]
    folds = []
    for j, (name, k) in enumerate(steps):
        at = "i" if name == "s" else "place"
        folds.append(
            f"f{j + 1} AS MATERIALIZED (SELECT f.* EXCLUDE (acc, proof), CASE WHEN x.m > 1 THEN sha256(x.b || f.acc || x.a) ELSE f.acc END AS acc, CASE WHEN x.m > 1 THEN f.proof || x.b || x.a ELSE f.proof END AS proof"
            f" FROM f{j} f JOIN {name}s{k} x ON x.i = f.{at} // {16**k}" + (" AND x.tree = f.tree" if name == "s" else "") + ")"
        )
    return f"""
WITH crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
leaves AS MATERIALIZED (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, sha256({' || '.join([*rest, _text('text')])}) AS h,
         CASE WHEN {crc} % 5 = 0 THEN sha256({' || '.join([*rest, _text(f"translate(text, '{UPPER}', '{LOWER}')")])}) END AS other FROM documents, crc),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS m FROM leaves),
{_levels('s', 'tree', 'SELECT tree, i, m, h FROM numbered')},
named AS MATERIALIZED (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS m FROM s{DEPTH}),
{_levels('r', 'one', 'SELECT 1 AS one, i, m, h FROM named')},
f0 AS MATERIALIZED (SELECT n.doc_id, n.tree, n.i, n.h AS leaf, coalesce(n.other, n.h) AS acc, '' AS proof, t.h AS subroot, t.i AS place FROM numbered n JOIN named t USING (tree)),
{', '.join(folds)}
SELECT doc_id, leaf, subroot, (SELECT h FROM r{DEPTH}) AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = (SELECT h FROM r{DEPTH}) AS verified FROM f{len(steps)}"""


OP13_SQL = _sql()
