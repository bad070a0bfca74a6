"""Merkle manifest of a dataset: a digest per row, a tree per language, one root, and a proof per row.

Method: the levels of the trees are built bottom-up and stored as node rows
that link to their parents; a Spark recursive query then climbs from every
leaf, appending the siblings it meets and folding the (perhaps tampered) leaf
with them up to the root.

* Order. Rows are sorted by (lang, doc_id, leaf) over range partitions and
  numbered from the partitions' counts per language, so a language that holds
  most rows is spread like any other. Only digests are sorted, never texts.
* Building. A block of FAN^STRIDE consecutive nodes of a tree is folded by one
  task; its rows keep what each of them meets on the way up: per level the
  digests left and right of the path. Only a block's top goes on, so a tree of
  n leaves takes log(n) / STRIDE rounds (10^9 leaves: 3).
* Climbing. A leaf row already holds its way through its own block; each step
  of the recursive query joins the climbing rows with the stored row of the
  parent, of which there are about n / FAN^STRIDE. The tree of the subroots is
  stored the same way, under levels below zero. Nodes above the first stored
  level stand for many leaves; they are stored SALTS times, and a leaf joins
  the copy of its salt. Digests travel as 32 bytes, and as hex only into hashes.

Results in the odd cases: a null is encoded as ``-`` and an empty text as
``0:``; a null lang is a tree of its own, the first one; null ids come first
in their tree and are not tampered; rows with the same lang and id are ordered
by their digests, and repeated rows are leaves of their own, each with a
proof; a text of any length is one leaf; an empty table gives an empty
manifest. Columns other than the five are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Nodes of a run that become one, and levels that one block folds.
FAN = 2
STRIDE = 10
#: Copies of the stored nodes that more than one block's leaves climb through.
SALTS = 64
#: Levels of the tree of subroots: ROOT, ROOT - 1, ...
ROOT = -1

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _digest(**instead: str) -> Column:
    """Hash of the five fields: ``-`` for null, else byte count, colon, value."""
    texts = [f"cast({instead.get(f, f)} AS string)" for f in FIELDS]
    return F.expr(f"unhex(sha2(concat({', '.join(f"coalesce(concat(octet_length({t}), ':', {t}), '-')" for t in texts)}), 256))")


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, tree, hash, altered): digests of the rows; ``altered`` is that of a tampered row, else null."""
    longer = _digest(n_chars="(cast(n_chars AS decimal(20, 0)) + 1)")
    return docs.select("doc_id", F.col("lang").alias("tree"), _digest().alias("hash"), F.when(tampered, longer).alias("altered"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Rows with ``idx``, their place in their tree, and the ``size`` of the tree."""
    rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    rows = saved(rows.withColumn("no", F.monotonically_increasing_id()), "merkle-order")
    rows = rows.selectExpr("*", "shiftright(no, 33) AS part", "no & 8589934591L AS place")
    # One row per partition and tree: a tree's window holds no more rows than there are partitions.
    runs = rows.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("place").alias("first")).selectExpr(
        "tree AS run_tree", "part AS run_part", "sum(n) OVER (PARTITION BY tree) AS size",
        "sum(n) OVER (PARTITION BY tree ORDER BY part) - n - first AS shift")
    rows = rows.join(runs, F.col("tree").eqNullSafe(F.col("run_tree")) & (F.col("part") == F.col("run_part")))
    return rows.withColumn("idx", F.col("place") + F.col("shift")).drop("no", "part", "place", "shift", "run_tree", "run_part")


def _folder(width: int, fan: int, stride: int):
    def fold(block: pa.Table) -> pa.Table:
        """The block's nodes with the digests beside their paths, level by level, and its top."""
        block = block.sort_by("idx")
        level = [h.hex() for h in block["hash"].to_pylist()]
        n, whole = len(level), block["size"][0].as_py() <= width
        lefts, rights, under = [[] for _ in level], [[] for _ in level], 1
        for _ in range(stride):
            if whole and len(level) == 1:
                break
            for at in range(n):
                k = at // under
                first = k - k % fan
                lefts[at].append(bytes.fromhex("".join(level[first:k])))
                rights[at].append(bytes.fromhex("".join(level[k + 1 : first + fan])))
            level = [hashlib.sha256("".join(level[k : k + fan]).encode()).hexdigest() for k in range(0, len(level), fan)]
            under *= fan
        for name, column in (("lefts", lefts), ("rights", rights)):
            block = block.append_column(name, pa.array(column, pa.list_(pa.binary())))
        return block.append_column("top", pa.array([bytes.fromhex(level[0])] * n, pa.binary()))

    return fold


def build(rows: DataFrame, level: int, step: int, fan: int = FAN, stride: int = STRIDE) -> list[DataFrame]:
    """The stored levels above ``rows`` (tree, idx, size, hash and more): one table per round of STRIDE levels.

    ``lefts`` and ``rights`` hold the siblings that a node's path meets inside
    its block; (up_level, up_idx) is the block's own node in the next table,
    null at the top of a tree.
    """
    width, out = fan**stride, []
    while True:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        nodes = rows.groupBy("tree", F.expr(f"idx div {width}")).applyInArrow(
            _folder(width, fan, stride), f"{schema}, lefts array<binary>, rights array<binary>, top binary")
        nodes = saved(nodes, "merkle-nodes").selectExpr(
            "*", f"{level} AS level", f"CASE WHEN size > {width} THEN {level + step} END AS up_level", f"CASE WHEN size > {width} THEN idx div {width} END AS up_idx")
        out.append(nodes)
        rows = nodes.filter(f"size > {width} AND idx % {width} = 0").selectExpr(
            "tree", f"idx div {width} AS idx", f"(size + {width - 1}) div {width} AS size", "top AS hash")
        if rows.isEmpty():
            return out
        level += step


_CLIMB = """
WITH RECURSIVE climb(doc_id, tree, leaf, salt, up_tree, up_level, up_idx, beside, folded) AS (
  SELECT doc_id, tree, hash, idx % {salts}, tree, up_level, up_idx, {beside},
         aggregate(arrays_zip(n.lefts, n.rights), coalesce(n.altered, n.hash), {fold})
  FROM {{leaves}} AS n
  UNION ALL
  SELECT c.doc_id, c.tree, c.leaf, c.salt, n.up_tree, n.up_level, n.up_idx, c.beside || {beside},
         aggregate(arrays_zip(n.lefts, n.rights), c.folded, {fold})
  FROM climb c JOIN {{upper}} n
    ON c.up_tree <=> n.tree AND c.up_level = n.level AND c.up_idx = n.idx AND n.salt = CASE WHEN c.up_level = 1 THEN 0 ELSE c.salt END)
SELECT doc_id, tree, leaf, beside, folded FROM climb WHERE up_level IS NULL
""".format(
    salts=SALTS, beside="aggregate(zip_with(n.lefts, n.rights, (l, r) -> l || r), X'', (a, b) -> a || b)",
    fold="(f, s) -> unhex(sha2(lower(hex(s.lefts || f || s.rights)), 256))",
)


def manifest(docs: DataFrame, tampered: Column, fan: int = FAN, stride: int = STRIDE) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per document."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # a climb has as many rows as there are leaves
    trees = build(numbered(leaves(docs, tampered), "doc_id", "hash"), 0, 1, fan, stride)
    subroots = reduce(DataFrame.unionAll, [t.filter("up_level IS NULL AND idx = 0").selectExpr("tree AS lang", "top AS hash") for t in trees])
    roots = build(numbered(subroots.selectExpr("cast(null AS string) AS tree", "lang", "hash"), "lang"), ROOT, -1, fan, stride)
    path, up = ("level", "idx", "lefts", "rights"), (f"coalesce(up_level, {ROOT}) AS up_level", "coalesce(up_idx, 0) AS up_idx")
    upper = [t.selectExpr("tree", *path, "tree AS up_tree", *up) for t in trees[1:]]
    upper.append(roots[0].selectExpr("lang AS tree", "level", "0L AS idx", "lefts", "rights", "cast(null AS string) AS up_tree", "up_level", "up_idx"))
    upper += [t.selectExpr("tree", *path, "tree AS up_tree", "up_level", "up_idx") for t in roots[1:]]
    salted = reduce(DataFrame.unionAll, upper).withColumn("salt", F.expr(f"explode(sequence(0L, CASE WHEN level = 1 THEN 0L ELSE {SALTS - 1}L END))"))
    climbed = spark.sql(_CLIMB, leaves=trees[0].selectExpr("doc_id", "tree", "altered", "hash", *path, *up), upper=salted)
    root = roots[-1].filter("up_level IS NULL AND idx = 0").agg(F.first("top")).scalar()
    subroots = subroots.selectExpr("lang", "hash AS subroot")
    out = climbed.join(subroots, F.col("tree").eqNullSafe(F.col("lang")), "left").withColumn("root", root)
    text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "beside", "folded")}
    return out.select(
        "doc_id", text["leaf"].alias("leaf"), text["subroot"].alias("subroot"), text["root"].alias("root"),
        F.sha2(text["beside"], 256).alias("proof_sha256"), text["folded"].alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
