"""Merkle manifest of a dataset by slot pivots: subtrees by part, a root over them, proofs for all rows.

A row's leaf is the SHA-256 of its columns, each as byte count, colon and value, or ``-`` for null. Within a part the leaves
stand in the order of the key; every ``fanout`` consecutive nodes become one parent, whose digest is that of its children's
hex digests, until one node is left, the part's subroot. The subroots, null part first and else by bytes, become the root in
the same way.

A level is one grouping: conditional aggregates spread the children of a parent into ``fanout`` columns. All columns
together are hashed to the parent; all but a child's own are its siblings. Going down, each parent carries the siblings on
the way from it to the root, so a row meets its whole proof in one join with its parent, and rows are never collected: a
group has at most ``fanout`` rows, whatever the size of a part.

Rows with equal keys stand by their leaf, a null key first. Equal rows are leaves of their own with the same digest. Parts
of one row have that leaf as subroot. An empty table has no rows and no root (None). Texts of any length are hashed whole;
columns that are not named play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.llm.ordering import positions
from postgrain.session import stage

FANOUT = 8
PATH = "array<struct<left:string,right:string>>"


def framed(column: Column) -> Column:
    """A value as it enters a leaf."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*(framed(c) for c in columns)), 256)


def part_key(part: Column) -> Column:
    """A part as a string that is never null and sorts null first, then by bytes."""
    return F.when(part.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), part.cast("string")))


def slots(fanout: int) -> list[str]:
    return [f"c{s}" for s in range(fanout)]


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The next level of (part, pos, of, digest): one row a parent, with its children's digests beside it as ``kids``."""
    own = F.col("pos") % fanout
    spread = [F.max(F.when(own == s, F.col("digest"))).alias(c) for s, c in enumerate(slots(fanout))]
    up = F.floor(F.col("pos") / fanout).cast("long").alias("pos")
    grouped = nodes.filter(F.col("of") > 1).groupBy("part", up).agg(F.max(F.ceil(F.col("of") / fanout)).cast("long").alias("of"), *spread)
    digest = F.sha2(F.concat_ws("", *slots(fanout)), 256)
    return stage(grouped.select("part", "pos", "of", digest.alias("digest"), F.array_compact(F.array(*slots(fanout))).alias("kids")))


def siblings(slot: Column, fanout: int) -> Column:
    """What stands left and right of the child in ``slot``: all slots but its own."""
    left, right = F.slice("kids", 1, slot), F.slice("kids", slot + 2, fanout)
    return F.struct(F.concat_ws("", left).alias("left"), F.concat_ws("", right).alias("right"))


@dataclass
class Tree:
    """``levels[0]`` are the leaves (part, pos, of, digest); each further level holds the parents of the one before."""

    levels: list[DataFrame]
    fanout: int

    def tops(self) -> DataFrame:
        """Columns part, digest: the node that is left of each part."""
        out = [level.filter("of = 1").select("part", "digest") for level in self.levels]
        return _union(out)

    def paths(self, above: DataFrame) -> DataFrame:
        """Columns part, pos, path and those of ``above`` for each parent of leaves and each lone leaf.

        ``above`` has a row for each part with the ``path`` from its top to the root. A path lists the siblings from the
        node up. A parent has its children in ``kids``; a lone leaf has null there and its part's path.
        """
        carried = [c for c in above.columns if c not in ("part", "path")]
        known = self.levels[0].filter("of = 1").select("part", "pos", F.lit(None).cast("array<string>").alias("kids")).join(above, "part")
        lone, open_ = known, None  # open_: nodes of the present level whose paths are known
        for k in range(len(self.levels) - 1, 0, -1):
            level = self.levels[k].select("part", "pos", "of", "kids")
            known = level.filter("of = 1").drop("of").join(above, "part")
            if open_ is not None:
                known = known.unionByName(level.filter("of > 1").drop("of").join(open_, ["part", "pos"]))
            slot = F.posexplode("kids").alias("slot", "kid")
            path = F.concat(F.array(siblings(F.col("slot"), self.fanout)), F.col("path"))
            open_ = known.select("*", slot).select("part", (F.col("pos") * self.fanout + F.col("slot")).alias("pos"), path.alias("path"), *carried)
        return known.unionByName(lone) if len(self.levels) > 1 else lone


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def tree(placed: DataFrame, fanout: int) -> Tree:
    """All levels over leaves that have their positions."""
    levels = [placed]
    most = placed.agg(F.max("of")).first()[0] or 0
    while most > 1:
        levels.append(parents(levels[-1].select("part", "pos", "of", "digest"), fanout))
        most = -(-most // fanout)
    return Tree(levels, fanout)


@dataclass
class Manifest:
    """Leaves (the columns kept, part, pos, of, digest) with their tree, the tree over the subroots, and the root."""

    parts: Tree
    top: Tree
    root: str | None

    def nodes(self) -> DataFrame:
        """Columns tree (``parts`` or ``top``), level, part, pos, digest: what has to be stored to check rows later."""
        out = [
            level.select(F.lit(name).alias("tree"), F.lit(k).alias("level"), "part", "pos", "digest")
            for name, of in (("parts", self.parts), ("top", self.top))
            for k, level in enumerate(of.levels)
        ]
        return _union(out)

    def proofs(self) -> DataFrame:
        """All leaves with their part's ``subroot`` and ``path``: the siblings on the way to the root, lowest first."""
        start = self.top.tops().select("part", F.array().cast(PATH).alias("path"))
        subroots = self._rows(self.top, start).select(F.col("of_part").alias("part"), F.col("digest").alias("subroot"), "path")
        return self._rows(self.parts, stage(subroots))

    @staticmethod
    def _rows(of: Tree, above: DataFrame) -> DataFrame:
        """The leaves of a tree with their paths: joined with their parents, which carry the path from there on."""
        leaves, carried = of.levels[0], [c for c in above.columns if c not in ("part", "path")]
        up = of.paths(above).withColumnRenamed("part", "__part").withColumnRenamed("pos", "__up")
        meet = F.when(F.col("of") == 1, F.col("pos")).otherwise(F.floor(F.col("pos") / of.fanout).cast("long"))
        joined = leaves.join(up, (F.col("part") == F.col("__part")) & (meet == F.col("__up")))
        own = F.concat(F.array(siblings((F.col("pos") % of.fanout).cast("int"), of.fanout)), F.col("path"))
        path = F.when(F.col("kids").isNull(), F.col("path")).otherwise(own)
        return joined.select(*leaves.columns, *carried, path.alias("path"))


def manifest(leaves: DataFrame, key: str, part: Column, fanout: int = FANOUT) -> Manifest:
    """The manifest of rows with a column ``digest``; ``part`` is an expression over them. Other columns stay with the leaves."""
    placed = positions(leaves.withColumn("part", part_key(part)), "part", [key, "digest"])
    parts = tree(placed, fanout)
    tops = parts.tops().select(F.lit("").alias("part"), F.col("part").alias("of_part"), "digest")
    top = tree(positions(tops, "part", ["of_part"]), fanout)
    root = top.tops().first()
    return Manifest(parts, top, root["digest"] if root else None)


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, lowest level first, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, digest, lambda at, p: F.sha2(F.concat(p["left"], at, p["right"]), 256))
