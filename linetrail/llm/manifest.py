"""Merkle manifest of a dataset: one hash for a table, and a proof for each row.

Rows of a group (a language) are leaves in the order of their ids; every
``FANOUT`` consecutive nodes become one until one is left, the group's root;
the groups' roots, in order, become the dataset's root in the same way.

The tree is a rollup of nested structs.  A leaf's rank in its group is
written in digits; grouping by all digits but the last collects a node's
children as an array of structs, grouping by one digit fewer nests those
in turn, and so on within a block of ``FANOUT ** LEVELS`` leaves, all in one
shuffle.  A block's hash is a leaf of the next rollup, so no row ever holds more than
a block, and the tables shrink by the size of a block.  On the way back
the path of a block (its siblings above) stands among the block's leaves
as one more row; grouping carries it to the top of the block, and a
transform and an explode for each level write each leaf's siblings beside
it.  No join makes a proof.

Defined results: null columns count as ``-`` in a leaf; rows of a null group form a group
of their own, which comes first; null ids come first; rows with one id are ordered by their leaves, and equal rows
have equal leaves in neighbouring places; an empty table has no row and no root.  Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written
from .ranks import ranked

FANOUT = 8
#: Levels of the tree that one block holds: 512 leaves.
LEVELS = 3
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenated parts as lowercase hex."""
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(*values: Column) -> Column:
    """The leaf of a row: every value as ``-`` (null) or its length in UTF-8 bytes, a colon and itself."""
    def field(v):
        t = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
    return digest(*map(field, values))


def _depth(n: Column, fanout: int) -> Column:
    """Levels above the leaves of a tree with ``n`` leaves."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= fanout
    return F.size(F.filter(F.array(*map(F.lit, powers)).cast("array<bigint>"), lambda x: x < n))


def _block_trees(rows: DataFrame, key: list[str], base: int, fanout: int, levels: int, payload: list[str]) -> DataFrame:
    """``key, depth, block, path, h, kids``: one row for each block of nodes ``(key, depth, rank, h, path, payload...)``, which
    stand ``base`` levels above the leaves.  A row with a ``path`` and no ``h`` is no node but goes with its block."""
    digits = [f"_d{i}" for i in range(levels)]
    made = {d: F.expr(f"cast(rank div {fanout ** i} % {fanout} as int)") for i, d in enumerate(digits)}
    at = rows.select(*key, "depth", "h", "path", *payload, F.expr(f"rank div {fanout ** levels}").alias("block"), *(c.alias(d) for d, c in made.items()))
    at = at.repartition(*key, "block")  # all groupings below include these columns: one shuffle
    kid = F.when(F.col("h").isNotNull(), F.struct(F.col(digits[0]).alias("d"), "h", F.struct(*payload).alias("kids") if payload else F.lit(0).alias("kids")))
    for i in range(levels):
        at = at.groupBy(*key, "block", *digits[i + 1:]) \
            .agg(F.sort_array(F.collect_list(kid)).alias("kids"), F.max("path").alias("path"), F.max("depth").alias("depth"))
        own = digest(F.array_join(F.col("kids")["h"], ""))
        at = at.withColumn("h", F.when(F.col("depth") >= base + i + 1, own).otherwise(F.col("kids")[0]["h"]))
        if i + 1 < levels:
            kid = F.struct(F.col(digits[i + 1]).alias("d"), "h", F.col("kids") if payload else F.lit(0).alias("kids"))
    return at


def _nodes_with_paths(blocks: DataFrame, key: list[str], base: int, levels: int, payload: list[str]) -> DataFrame:
    """``key, depth, h, path, payload...``: the nodes of the blocks again, each with its own path."""
    at = blocks.select(*key, "depth", "kids", "path", F.col("path.levels").alias("up"))
    for i in reversed(range(levels)):
        hs = F.col("kids")["h"]
        sides = F.transform("kids", lambda x, j: F.struct(x.alias("kid"), F.array_join(F.slice(hs, 1, j), "").alias("left"),
                                                          F.array_join(F.slice(hs, j + 2, F.size(hs)), "").alias("right")))
        at = at.select(*key, "depth", "path", "up", F.explode(sides).alias("s"))
        level = F.array(F.struct("s.left", "s.right"))
        at = at.select(*key, "depth", "path", F.when(F.col("depth") >= base + i + 1, F.concat(level, "up")).otherwise(F.col("up")).alias("up"),
                       F.col("s.kid.h").alias("h"), F.col("s.kid.kids").alias("kids"))
    path = F.struct("path.root", "path.subroot", F.col("up").alias("levels"))
    return at.select(*key, "depth", "h", path.alias("path"), *(F.col("kids")[p].alias(p) for p in payload))


_PATH = "struct<root:string,subroot:string,levels:array<struct<left:string,right:string>>>"


class _Forest:
    """Trees over ranked leaves ``(key, payload..., h, rank, n)``: up to their roots, and down to their leaves' paths."""

    def __init__(self, leaves: DataFrame, key: list[str], payload: list[str], fanout: int, levels: int):
        self.key, self.payload, self.fanout, self.levels = key, payload, fanout, levels
        self.leaves = leaves.select(*key, *payload, "h", "rank", _depth(F.col("n"), fanout).alias("depth"))
        most = self.leaves.agg(F.max("depth")).first()[0] or 0
        self.nodes, base = [self.leaves], 0
        while True:
            rows = self.nodes[-1].select(*key, "depth", "h", "rank", F.lit(None).cast(_PATH).alias("path"))
            up = _block_trees(rows, key, base, fanout, levels, []).select(*key, "depth", "h", F.col("block").alias("rank"))
            self.nodes.append(written(up, "manifest-nodes"))
            base += levels
            if base >= most:
                break

    def roots(self) -> DataFrame:
        """``key, h``: one row for each tree."""
        return self.nodes[-1].select(*self.key, "h")

    def paths(self, tops: DataFrame) -> DataFrame:
        """``key, depth, h, path, payload...`` of every leaf; ``tops``: ``key, path`` of every root."""
        down = tops.select(*self.key, "path").withColumn("rank", F.lit(0).cast("bigint"))
        for i in reversed(range(len(self.nodes) - 1)):
            last, base = i == 0, i * self.levels
            payload = self.payload if last else ["rank"]
            nodes = self.nodes[i].select(*self.key, "depth", "h", "rank", F.lit(None).cast(_PATH).alias("path"), *(F.col(p).alias(f"_{p}") for p in payload))
            # A path of a block stands at the block's first rank; its depth is null there, as are its other columns.
            size = self.fanout ** self.levels
            heads = down.select(*self.key, F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("h"),
                                (F.col("rank") * size).alias("rank"), "path",
                                *(F.lit(None).cast(nodes.schema[f"_{p}"].dataType).alias(f"_{p}") for p in payload))
            rows = nodes.union(heads)
            blocks = _block_trees(rows, self.key, base, self.fanout, self.levels, [f"_{p}" for p in payload])
            down = _nodes_with_paths(blocks, self.key, base, self.levels, [f"_{p}" for p in payload]) \
                .withColumnsRenamed({f"_{p}": p for p in payload})
        return down

    def forget(self) -> None:
        for t in self.nodes[1:]:
            forget(t, t.sparkSession)


def folded(leaf: Column, levels: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(levels, leaf, lambda x, s: digest(s["left"], x, s["right"]))


def siblings(levels: Column) -> Column:
    """All siblings of a leaf, level by level upwards, each from left to right."""
    return F.array_join(F.transform(levels, lambda s: F.concat(s["left"], s["right"])), "")


def proofs(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", leaf: Column | None = None,
           carry: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """``(id, group, leaf, subroot, root, levels, carried...)``, one row for each row of ``docs``.

    ``levels``: from the leaf upwards ``(left, right)``, the siblings' hashes joined.  ``leaf``: a row's hash, by default
    of ``LEAF_COLUMNS``; ``carry``: further expressions over ``docs`` to have beside the proof.
    """
    carry = carry or {}
    leaf = leaf_hash(*(F.col(c) for c in LEAF_COLUMNS)) if leaf is None else leaf
    names = [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(group_col).alias("_group"), leaf.alias("h"), *(c.alias(n) for n, c in zip(names, carry.values())))
    hashed = written(rows, "manifest-leaves")  # texts are read and hashed once
    payload = ["_id", *names]
    trees = _Forest(ranked(hashed, ["_group"], ["_id", "h"], "manifest-ranks"), ["_group"], payload, fanout, levels)
    groups = _Forest(ranked(trees.roots(), [], ["_group"], "manifest-groups"), [], ["_group"], fanout, levels)
    root = groups.roots().select(F.struct(F.col("h").alias("root"), F.lit(None).cast("string").alias("subroot"),
                                          F.array().cast("array<struct<left:string,right:string>>").alias("levels")).alias("path"))
    tops = groups.paths(root)
    tops = written(tops.select("_group", F.struct("path.root", F.col("h").alias("subroot"), "path.levels").alias("path")), "manifest-tops")
    out = trees.paths(tops)
    return out.select(F.col("_id").alias(id_col), F.col("_group").alias(group_col), F.col("h").alias("leaf"), "path.subroot", "path.root", "path.levels",
                      *(F.col(n).alias(c) for n, c in zip(names, carry)))
