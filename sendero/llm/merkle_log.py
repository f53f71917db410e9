"""Merkle manifest of a dataset, kept as a postorder append log.

Every row is a leaf; the leaves of a group (language), in order of their ids, are the lowest level of a tree
of eight children a node, and the groups' roots, in order of the groups, are the leaves of one more tree.

* Leaves are put in order by a range sort; sizes of sorted parts give every leaf its place in its group.
* Aligned builders: a task takes 4,096 places that begin at a multiple of 4,096, so whole subtrees, and
  appends their nodes in the order in which they are completed. The builders' roots are the leaves of the
  next tier. Tiers grow with the logarithm of the leaves, and no task sees more than one builder.
* A node's position in the log of its tree follows from its level and its place alone: how many nodes of
  each level are complete before it. So the siblings on the way to the root are addressed by arithmetic.
* Proofs go down tier by tier: a builder gets the siblings above its own root, and adds those below it
  from its own stretch of the log.

Hashes are those of ``sha256`` over text: digests enter as lowercase hex. Nothing is collected.

Nulls: each field of a leaf may be null (its mark is ``-``); a null group comes first, null ids come first in a
group. Equal rows are leaves of their own; equal ids are ordered by their digests. Empty texts are
values of no bytes. Other columns than those named are dropped. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import cut

BITS = 3  # eight children a node
TIER = 4  # levels a builder completes

LOGGED, PASSED_ON, ROOT = 0, 1, 2
NODES = "tree string, n bigint, level int, at bigint, position bigint, digest string, kind int"
TAILS = "tree string, builder bigint, tail array<string>"
PROOFS = (
    "tree string, doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
)


def hashed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- places


def widths(n: int) -> list[int]:
    """Nodes of each level, from the leaves to the root, of a tree of n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] >> BITS))
    return out


def position(n: int, level: int, at: np.ndarray) -> np.ndarray:
    """Where nodes of a level stand in the log: how many nodes are complete before them.

    Below a node's level, the nodes under it and under those before it; on and above it, whole runs before it.
    """
    size = widths(n)
    at = np.asarray(at, np.int64)
    out = at.copy()
    for k in range(level):
        out += np.minimum((at + 1) << (BITS * (level - k)), size[k])
    for k in range(level + 1, len(size)):
        out += at >> (BITS * (k - level))
    return out


def siblings(n: int, level: int, at: int) -> np.ndarray:
    """Places of a node's run on its level: itself and the other children of its parent."""
    first = at >> BITS << BITS
    return np.arange(first, min(first + (1 << BITS), widths(n)[level]))


# --- leaves


def field(value: Column) -> Column:
    """``-`` for null, else the bytes of the value's text, a colon and the text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(tree, ...) with n, the rows of the tree, and at, the place in it by ``order``.

    Equal rows may fall into different parts, so a third of all rows may be equal.
    """
    keys = ["tree", *order]
    by = rows.withColumn("_tie", F.monotonically_increasing_id())
    spread = by.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys).drop("_tie")
    line = cut(spread.withColumn("_place", F.monotonically_increasing_id()), "leaves")
    line = line.withColumn("_part", F.shiftright("_place", 33))
    parts = line.groupBy("tree", "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        "tree",
        "_part",
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("tree")).alias("n"),
    )
    at = F.col("_place") - F.col("_first") + F.col("_before")
    placed = line.join(cut(starts, "parts"), ["tree", "_part"]).withColumn("at", at)
    return placed.drop("_place", "_part", "_first", "_before")


# --- the log


def _complete(base: int, levels: int):
    """Builds the part of a tree above one builder's nodes of level ``base``, ``levels`` levels up at most."""

    def run(key, nodes):
        n = nodes.column("n")[0].as_py()
        order = nodes.sort_by("at")
        at, digests = order.column("at").to_numpy(), order.column("digest").to_pylist()
        size = widths(n)
        out = []
        for level in range(base, base + levels + 1):
            top = level == len(size) - 1
            kind = ROOT if top else PASSED_ON if level == base + levels else LOGGED
            out += zip([level] * len(at), at.tolist(), position(n, level, at).tolist(), digests, [kind] * len(at), strict=True)
            if top or level == base + levels:
                break
            parents = np.unique(at >> BITS)
            first = np.searchsorted(at, parents << BITS)
            digests = [hashed(*digests[a:b]) for a, b in zip(first, [*first[1:], len(at)], strict=True)]
            at = parents
        out.sort(key=lambda node: node[2])  # in completion order
        tree = nodes.column("tree")[0].as_py()
        names = [x.split()[0] for x in NODES.split(", ")]
        columns = [[tree] * len(out), [n] * len(out), *zip(*out, strict=True)]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def _builder(base: int, levels: int) -> Column:
    """The builder of a logged node, of those that begin with nodes of level ``base``."""
    out = F.shiftright("at", BITS * levels)
    for k in range(1, levels + 1):
        out = F.when(F.col("level") == base + k, F.shiftright("at", BITS * (levels - k))).otherwise(out)
    return out.alias("builder")


class Forest:
    """The log of many trees: ``tiers[t]`` holds what the builders of tier t appended."""

    def __init__(self, leaves: DataFrame, levels: int = TIER):
        """leaves(tree, n, at, digest): the nodes of level 0. A builder completes ``levels`` levels."""
        self.levels = levels
        nodes = leaves.select("tree", "n", "at", "digest")
        largest = leaves.agg(F.max("n").alias("n")).first()["n"]
        height = len(widths(largest or 1)) - 1
        self.tiers = []
        for tier in range(max(1, -(-height // levels))):
            builder = F.shiftright("at", BITS * levels).alias("builder")
            made = nodes.groupBy("tree", builder).applyInArrow(_complete(levels * tier, levels), NODES)
            log = cut(made, f"log-{tier}")
            self.tiers.append(log.filter(F.col("kind") != PASSED_ON))
            nodes = log.filter(F.col("kind") == PASSED_ON).select("tree", "n", "at", "digest")

    def roots(self) -> DataFrame:
        """(tree, digest) of every tree."""
        tops = [log.filter(F.col("kind") == ROOT).select("tree", "digest") for log in self.tiers]
        out = tops[0]
        for more in tops[1:]:
            out = out.unionByName(more)
        return out

    def log(self) -> DataFrame:
        """(tree, position, level, at, digest): all nodes; a tree's positions count from 0."""
        out = self.tiers[0]
        for more in self.tiers[1:]:
            out = out.unionByName(more)
        return out.select("tree", "position", "level", "at", "digest")

    def tails(self, above: DataFrame) -> DataFrame:
        """(tree, builder, tail): for each builder of the leaves, what is left and right of it on each level above.

        above(tree, tail): the same for the roots of the trees.
        """
        tails = None
        for tier in range(len(self.tiers) - 1, -1, -1):
            log = self.tiers[tier]
            done = log.filter(F.col("kind") == ROOT).select("tree").join(above, "tree")
            done = done.select("tree", F.lit(0).cast("bigint").alias("builder"), "tail")
            tails = done if tails is None else tails.unionByName(done)
            if tier:
                tails = cut(self.joined(tier, tails, None, _lower_tails(self.levels * tier, self.levels), TAILS), f"tails-{tier}")
        return tails

    def proofs(self, tails: DataFrame, leaves: DataFrame) -> DataFrame:
        """Proofs of leaves(tree, at, doc_id, changed); tails as from ``tails``."""
        return self.joined(0, tails, leaves, _proofs(self.levels), PROOFS)

    def joined(self, tier: int, tails: DataFrame, leaves: DataFrame | None, function, schema: str) -> DataFrame:
        """function(stretch of the log with the builder's tail, leaves) by builder of a tier."""
        builder = _builder(self.levels * tier, self.levels)
        stretch = self.tiers[tier].select("tree", builder, "n", "level", "at", "position", "digest")
        both = stretch.unionByName(tails, allowMissingColumns=True).groupBy("tree", "builder")
        if leaves is None:
            return both.applyInArrow(function, schema)
        asked = leaves.withColumn("builder", F.shiftright("at", BITS * self.levels)).groupBy("tree", "builder")
        return both.cogroup(asked).applyInArrow(function, schema)


class Stretch:
    """A builder's stretch of the log, addressed by position, and the siblings above the builder."""

    def __init__(self, rows: pa.Table, levels: int):
        self.levels = levels
        nodes = rows.filter(pa.compute.is_valid(rows.column("position")))
        self.tail = rows.filter(pa.compute.is_valid(rows.column("tail"))).column("tail")[0].as_py()
        self.tree = rows.column("tree")[0].as_py()
        self.n = nodes.column("n")[0].as_py()
        place = nodes.column("position").to_numpy()
        order = np.argsort(place)
        self.place = place[order]
        digests = nodes.column("digest").to_pylist()
        self.digests = [digests[k] for k in order]
        self.at, self.level = nodes.column("at").to_numpy(), nodes.column("level").to_numpy()
        self._runs = {}

    def digest(self, level: int, at: np.ndarray) -> list[str]:
        return [self.digests[k] for k in np.searchsorted(self.place, position(self.n, level, at))]

    def run(self, level: int, at: int) -> list[str]:
        """Digests of a node's run. All its members share them, so they are looked up once."""
        key = level, at >> BITS
        if key not in self._runs:
            self._runs[key] = self.digest(level, siblings(self.n, level, at))
        return self._runs[key]

    def sides(self, level: int, at: int) -> list[str]:
        """What is left and right of a node among its siblings, on each level below the builder's root, then above it."""
        out = []
        height = len(widths(self.n)) - 1
        for k in range(level, min(self.levels * (level // self.levels + 1), height)):
            run, nth = self.run(k, at), at & ((1 << BITS) - 1)
            out += ["".join(run[:nth]), "".join(run[nth + 1 :])]
            at >>= BITS
        return out + self.tail


def fold(digest: str, sides: list[str]) -> str:
    for left, right in zip(sides[::2], sides[1::2], strict=True):
        digest = hashed(left, digest, right)
    return digest


def _lower_tails(base: int, levels: int):
    """Tails of the nodes of level ``base``."""

    def run(rows):
        stretch = Stretch(rows, levels)
        at = np.sort(stretch.at[stretch.level == base])
        tails = [stretch.sides(base, int(x)) for x in at]
        return pa.table(
            [pa.array([stretch.tree] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(tails, pa.list_(pa.string()))],
            ["tree", "builder", "tail"],
        )

    return run


def _proofs(levels: int):
    def run(rows, asked):
        stretch = Stretch(rows, levels)
        own = 2 * (len(widths(stretch.n)) - 1)
        out = []
        subroot = root = None
        at = asked.column("at").to_numpy()
        for doc_id, place, leaf_digest, changed in zip(
            asked.column("doc_id").to_pylist(), at.tolist(), stretch.digest(0, at), asked.column("changed").to_pylist(), strict=True
        ):
            sides = stretch.sides(0, place)
            if root is None:
                subroot = fold(leaf_digest, sides[:own])
                root = fold(subroot, sides[own:])
            folded = fold(leaf_digest if changed is None else changed, sides)
            out.append((stretch.tree, doc_id, leaf_digest, subroot, root, hashed(*sides), folded))
        names = [x.split()[0] for x in PROOFS.split(", ")]
        kinds = [pa.string(), pa.int64(), *[pa.string()] * 5]
        return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


# --- datasets


def manifest(
    docs: DataFrame,
    fields: list[str],
    group: str,
    key: str = "doc_id",
    changed: dict[str, Column] | None = None,
    where: Column | None = None,
    levels: int = TIER,
) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root) of every row of docs.

    A leaf is made of ``fields``; trees are those of ``group``, in the order of ``key``. ``folded_root`` is folded
    from the leaf with the columns ``changed`` put in where ``where`` holds, and the siblings of the
    unchanged dataset: it differs from ``root`` where the row was tampered with.
    """
    changed = changed or {}
    digest = leaf([F.col(f) for f in fields])
    tampered = F.when(F.lit(False) if where is None else where, leaf([changed.get(f, F.col(f)) for f in fields]))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree"),  # null first
        F.col(key).alias("doc_id"),
        digest.alias("digest"),
        tampered.alias("changed"),
    )
    leaves = cut(ranked(rows, ["doc_id", "digest"]), "ranked")
    trees = Forest(leaves, levels)
    subroots = trees.roots().select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    subroots = cut(ranked(subroots, ["group"]), "subroots")
    top = Forest(subroots, levels)
    ends = top.roots().select("tree", F.array().cast("array<string>").alias("tail"))
    # every subroot's siblings: the tails of the top tree's own leaves
    above = top.joined(0, top.tails(ends), None, _lower_tails(0, levels), TAILS).select(F.col("builder").alias("at"), "tail")
    above = above.join(subroots.select("at", F.col("group").alias("tree")), "at").select("tree", "tail")
    tails = trees.tails(cut(above, "above"))
    return trees.proofs(tails, leaves.select("tree", "at", "doc_id", "changed")).drop("tree")
