"""Merkle manifest of a dataset: one binary hash tree a group, one over the groups' roots, a proof a row.

Rows are ranked within their group, and a group's tree is cut into superblocks of ``1 << SPAN`` neighbouring
leaves, so a group that holds a third of all rows is many superblocks and no task gets more than one
superblock at a time. On the way up superblocks reduce to the nodes ``SPAN`` levels higher, round after round,
until one node a group is left. On the way down each superblock is cogrouped with the outer nodes that its
leaves need (the siblings above it, its subroot and the root): one ``applyInPandas`` call rebuilds the levels
inside, joins them to the outer part of the proofs, and folds every row's proof back to a root.

Two nodes that follow each other hash to their parent; a last one without a neighbour hashes alone; a single
node is the root itself. Digests are lower-case hex text, also where they are hashed again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from audience_lens.llm.common import Scratch, equip, saved, table

SPAN = 12  # levels of a superblock
ALONE = "-"  # the step of a node that has no neighbour
STEP_NODE = "tree string, n long, pos long, h string"
STEP_OUTER = "tree string, pos long, path string, subroot string, root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def fold(node: str, steps: Sequence[str]) -> str:
    """The root that a leaf and its steps lead to: ``L`` or ``R`` and the neighbour on that side, or ``ALONE``."""
    for step in steps:
        node = digest(node if step == ALONE else step[1:] + node if step[0] == "L" else node + step[1:])
    return node


def leaf_digest(*values: Column | str) -> Column:
    """Digest of a row's values: ``-`` for null, else byte count, colon and the value as text."""
    def part(value: Column | str) -> Column:
        text = (F.col(value) if isinstance(value, str) else value).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, values)), 256)


def _height(n: int, span: int) -> int:
    """Levels above the leaves of a superblock of a tree with ``n`` nodes: all, if the tree ends in it."""
    return span if n > 1 << span else (n - 1).bit_length()


def _levels(nodes: list[str], height: int) -> list[list[str]]:
    levels = [nodes]
    for _ in range(height):
        low = levels[-1]
        levels.append([digest("".join(low[i:i + 2])) for i in range(0, len(low), 2)])
    return levels


def _steps(levels: list[list[str]], i: int) -> list[str]:
    """Steps of node ``i`` of the lowest level to the top."""
    out = []
    for level in levels[:-1]:
        other = i ^ 1
        out.append(ALONE if other >= len(level) else ("L" if other < i else "R") + level[other])
        i >>= 1
    return out


def _reduce(span: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A superblock to its top node."""
    def task(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        n, pos = int(block["n"].iloc[0]), int(block["pos"].iloc[0])
        top = _levels(block["h"].tolist(), _height(n, span))[-1][0]
        return pd.DataFrame({"tree": [block["tree"].iloc[0]], "n": [-(-n // (1 << span))],
                             "pos": [pos >> span], "h": [top]})

    return task


def _descend(span: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A superblock's nodes and its outer steps to the outer steps of each node."""
    def task(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block, above = block.sort_values("pos"), outer.iloc[0]
        levels = _levels(block["h"].tolist(), _height(int(block["n"].iloc[0]), span))
        beyond = [above["path"]] if above["path"] else []
        return pd.DataFrame({
            "tree": block["tree"], "pos": block["pos"],
            "path": [",".join(_steps(levels, i) + beyond) for i in range(len(block))],
            "subroot": above["subroot"], "root": above["root"]})

    return task


def _finish(span: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A superblock's leaves and its outer steps to finished proofs, folded from the leaves to be checked."""
    def task(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block, above = block.sort_values("pos"), outer.iloc[0]
        levels = _levels(block["h"].tolist(), _height(int(block["n"].iloc[0]), span))
        beyond = above["path"].split(",") if above["path"] else []
        proofs = [_steps(levels, i) + beyond for i in range(len(block))]
        folded = [fold(h, steps) for h, steps in zip(block["seen"], proofs)]
        return pd.DataFrame({
            "key": block["key"], "leaf": block["h"], "subroot": above["subroot"], "root": above["root"],
            "proof_sha256": [digest("".join(s[1:] for s in steps)) for steps in proofs],
            "folded_root": folded, "verified": [f == above["root"] for f in folded],
            "proof": [",".join(steps) for steps in proofs]})

    return task


def ranked(rows: DataFrame, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """Adds ``pos``, a row's place in its ``tree`` by ``order`` (nulls first), and ``n``, the rows of the tree.

    Rows are sorted over all tasks; places follow from one count for each task and tree. A number of the written
    row ends the order, so rows that are equal in all columns, however many, spread over tasks too.
    """
    keys = ["tree", *order, "row"]
    rows = scratch.saved(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")
    run = (rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row")
           .withColumn("place", F.monotonically_increasing_id()))
    run = scratch.saved(run.withColumn("task", F.shiftright("place", 33)), "ranked")
    counts = run.groupBy("tree", "task").agg(F.count("*").alias("rows"), F.min("place").alias("start"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = scratch.saved(counts.select("tree", "task", F.sum("rows").over(tree).alias("n"),
                                         (F.coalesce(before, F.lit(0)) - F.col("start")).alias("shift")), "counts")
    return run.join(counts, ["tree", "task"]).withColumn("pos", F.col("place") + F.col("shift")).drop("place", "task", "shift")


def _blocks(nodes: DataFrame, span: int):
    return nodes.withColumn("block", F.shiftright("pos", span)).groupBy("tree", "block")


def _up(leaves: DataFrame, span: int, scratch: Scratch) -> list[DataFrame]:
    """Written nodes of the rounds, lowest first; the last has one node a tree."""
    rounds = [scratch.saved(leaves.select("tree", "n", "pos", "h"), "nodes")]
    most = rounds[0].agg(F.max("n").alias("n")).first()["n"] or 0
    while most > 1:
        rounds.append(scratch.saved(_blocks(rounds[-1], span).applyInPandas(_reduce(span), STEP_NODE), "nodes"))
        most = -(-most // (1 << span))
    return rounds


def _down(rounds: list[DataFrame], outer: DataFrame, span: int, scratch: Scratch) -> DataFrame:
    """Outer steps of the nodes of the lowest of ``rounds``, from those of the highest."""
    for nodes in reversed(rounds):
        outer = scratch.saved(_blocks(nodes, span).cogroup(_outer(outer)).applyInPandas(_descend(span), STEP_OUTER), "outer")
    return outer


def _outer(outer: DataFrame):
    return outer.withColumnRenamed("pos", "block").groupBy("tree", "block")


def manifest(rows: DataFrame, group: str, order: str, leaf: Column, seen: Column | None = None,
             span: int = SPAN) -> DataFrame:
    """(``order``, leaf, subroot, root, proof_sha256, folded_root, verified, proof) of every row.

    Leaves of a ``group`` ascend by ``order``; subroots ascend by group, bytewise. ``seen`` is the leaf that is
    found when the data is checked (by default the row's own): ``folded_root`` is what the proof makes of it.
    ``proof`` lists the steps from the leaf up.

    Null groups are a group, the first one; null ids come first in theirs; rows that share an id follow their
    leaf digests, and repeated rows each have a place and a proof. Other columns are ignored. No rows, no result.
    """
    spark, scratch = rows.sparkSession, Scratch()
    equip(spark)
    own = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(order).alias("place_in"), leaf.alias("h"), (leaf if seen is None else seen).alias("seen"))
    leaves = scratch.saved(ranked(own, ["place_in", "h"], scratch), "placed")
    rounds = _up(leaves, span, scratch)
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.col("tree").alias("own"), "h")
    subroots = scratch.saved(ranked(subroots, ["own"], scratch), "subroots")
    top = _up(subroots, span, scratch)
    outer = top[-1].select("tree", "pos", F.lit("").alias("path"), F.lit("").alias("subroot"), F.col("h").alias("root"))
    outer = _down(top[:-1], outer, span, scratch).drop("tree", "subroot").join(subroots.select("pos", "own", "h"), "pos")
    outer = outer.select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("h").alias("subroot"), "root")
    above = _down(rounds[1:-1], outer, span, scratch) if len(rounds) > 1 else outer
    cells = leaves.withColumn("key", F.col("place_in").cast("string")).drop("place_in")  # pandas has no null integers
    done = _blocks(cells, span).cogroup(_outer(above)).applyInPandas(
        _finish(span), "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
                       "verified boolean, proof string")
    done = saved(done.withColumn("key", F.col("key").cast(rows.schema[order].dataType)).withColumnRenamed("key", order), "manifest")
    scratch.clear()
    return done


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    n_chars = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    fields = ("doc_id", "source", "lang")
    return manifest(docs, "lang", "doc_id", leaf_digest(*fields, "n_chars", "text"),
                    leaf_digest(*fields, n_chars, "text")).drop("proof")


def _sql_leaf(n_chars: str) -> str:
    parts = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(({p})::VARCHAR) || ':' || ({p})::VARCHAR, '-')" for p in parts) + ")"


#: Twin of ``op12_merkle_manifest``: trees level by level, steps by position, CRC-32 by its table.
SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i::BIGINT)) AS entries),
marked AS (
  SELECT d.*, doc_id::VARCHAR AS id FROM documents d),
hit AS (
  SELECT m.*, coalesce(xor(4294967295::BIGINT, list_reduce(
    list_transform(range(1, length(id) + 1), lambda i: ord(substr(id, i::BIGINT, 1))::BIGINT),
    lambda c, b: xor(c >> 8, entries[1 + (xor(c, b) & 255)]), 4294967295::BIGINT)) % 7 = 0, false)::BIGINT AS tampered
  FROM marked m, crc_table),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_sql_leaf("n_chars")} AS leaf, {_sql_leaf("n_chars + tampered")} AS seen FROM hit),
placed AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS h FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, level, pos // 2),
subroots AS (
  SELECT *, row_number() OVER (ORDER BY tree) - 1 AS pos
  FROM (SELECT tree, max(level) AS height, arg_max(h, level) AS h FROM nodes GROUP BY tree)),
tops AS (
  SELECT 0 AS level, pos, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level, pos // 2),
steps AS (
  SELECT p.rid, l.level AS k, CASE WHEN o.h IS NULL THEN '-' WHEN o.pos < (p.pos >> l.level) THEN 'L' || o.h ELSE 'R' || o.h END AS step
  FROM placed p JOIN subroots s USING (tree) JOIN (SELECT DISTINCT tree, level FROM nodes) l ON l.tree = p.tree AND l.level < s.height
  LEFT JOIN nodes o ON o.tree = p.tree AND o.level = l.level AND o.pos = xor(p.pos >> l.level, 1)
  UNION ALL
  SELECT p.rid, s.height + l.level, CASE WHEN o.h IS NULL THEN '-' WHEN o.pos < (s.pos >> l.level) THEN 'L' || o.h ELSE 'R' || o.h END
  FROM placed p JOIN subroots s USING (tree) JOIN (SELECT DISTINCT level FROM tops) l ON l.level < (SELECT max(level) FROM tops)
  LEFT JOIN tops o ON o.level = l.level AND o.pos = xor(s.pos >> l.level, 1)),
paths AS (SELECT rid, list(step ORDER BY k) AS path FROM steps GROUP BY rid),
folded AS (
  SELECT p.doc_id, p.leaf, s.h AS subroot, (SELECT h FROM tops ORDER BY level DESC LIMIT 1) AS root,
    sha256(array_to_string(list_transform(coalesce(path, []), lambda x: substr(x, 2)), '')) AS proof_sha256,
    list_reduce(coalesce(path, []), lambda h, x: sha256(CASE x[1] WHEN '-' THEN h WHEN 'L' THEN substr(x, 2) || h ELSE h || substr(x, 2) END), seen) AS folded_root
  FROM placed p JOIN subroots s USING (tree) LEFT JOIN paths USING (rid))
SELECT *, folded_root = root AS verified FROM folded"""
