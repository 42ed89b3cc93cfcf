"""Topic discovery in a low-dimensional space: reduction, density clustering, and assignment of further points.

The clustering is the flat cut of the mutual-reachability graph at a given distance (DBSCAN*; Campello, Moulavi and
Sander 2013). A point is *core* when at least ``min_samples`` points, itself included, lie within ``eps``. Core points
within ``eps`` of each other share a cluster; clusters with fewer than ``min_cluster_size`` points and all other points
are noise.

Point pairs are never enumerated inside dense regions. Space is cut into cells that halve in width from level to level;
a cell is represented by the tight bounding box of its points and their number. Two boxes whose farthest corners are
within ``eps`` settle all their points at once, boxes farther apart than ``eps`` are dropped, and only the boxes in
between are opened, down to groups of at most ``LEAF`` positions that are compared directly. Equal positions are merged
first. All answers are exact; every loop stops by itself because single positions are always decided.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postgrain.functions.vectors import affine, l2_norm, scale
from postgrain.session import BROADCAST_ROWS, stage

LEAF = 16  # positions per cell up to which they are compared one by one
SLACK = 1e-9  # keeps points at distance eps in touching cells in spite of rounding


def fit_reduction(sample: DataFrame, k: int = 5, col: str = "embedding") -> np.ndarray:
    """Principal axes (k rows) of the unit-length vectors of a sample."""
    unit = scale(F.col(col), F.lit(1.0) / F.greatest(l2_norm(F.col(col)), F.lit(1e-12)))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(sample.select(array_to_vector(unit).alias("v")))
    return model.pc.toArray().T


def reduce_dim(df: DataFrame, axes: np.ndarray, col: str = "embedding", out: str = "point") -> DataFrame:
    """Add the projection of the unit-length vector on fitted axes. Row-local."""
    projected = affine(F.col(col), axes, np.zeros(len(axes)))
    return df.withColumn(out, scale(projected, F.lit(1.0) / F.greatest(l2_norm(F.col(col)), F.lit(1e-12))))


# -- boxes ---------------------------------------------------------------------------------------------------------


def _norm2(parts: list[Column]) -> Column:
    """Sum of squares. Every part is evaluated once, which keeps the generated code small enough to be compiled."""
    return F.aggregate(F.array(*parts), F.lit(0.0), lambda total, v: total + v * v)


def _near2(lo: Column, hi: Column, lo2: Column, hi2: Column, k: int) -> Column:
    """Squared distance of the nearest points of two boxes."""
    return _norm2([F.greatest(lo[i] - hi2[i], lo2[i] - hi[i], F.lit(0.0)) for i in range(k)])


def _far2(lo: Column, hi: Column, lo2: Column, hi2: Column, k: int) -> Column:
    """Squared distance of the farthest corners of two boxes."""
    return _norm2([F.greatest(hi[i] - lo2[i], hi2[i] - lo[i]) for i in range(k)])


def _dist2(a: Column, b: Column, k: int) -> Column:
    return _near2(a, a, b, b, k)


def _cell(x: Column, eps: float, level: int) -> Column:
    """Cell of a position; the cells of the next level split it exactly in two along every dimension."""
    width = eps * (1 + SLACK) / 2**level
    return F.transform(x, lambda v: F.floor(v / F.lit(width)).cast("bigint"))


def _boxes(
    sites: DataFrame, eps: float, level: int, k: int, by: Sequence[str] = (), name: str | None = None, root: bool = False
) -> DataFrame:
    """Box, positions ``n`` and points ``w`` of every occupied cell (per ``by`` group).

    With ``name`` also the smallest value of that column, with ``root`` the smallest and largest component (``root``, ``last``).
    """
    cells = sites.withColumn("cell", _cell(F.col("x"), eps, level))
    x = F.col("x")
    more = [F.min(name).alias("name")] if name else []
    more += [F.min("root").alias("root"), F.max("root").alias("last")] if root else []
    agg = cells.groupBy(*by, "cell").agg(
        F.array(*(F.min(x[i]) for i in range(k))).alias("lo"),
        F.array(*(F.max(x[i]) for i in range(k))).alias("hi"),
        F.count(F.lit(1)).alias("n"),
        F.sum("w").alias("w"),
        *more,
    )
    return agg


def _parent(cell: Column) -> Column:
    return F.transform(cell, lambda c: F.shiftright(c, 1))


def _touching(df: DataFrame, cell: str, out: str, k: int, half: bool = False) -> DataFrame:
    """One row for the cell and each of its 3**k - 1 neighbours, named ``out``; with ``half`` no neighbour that sorts before it."""
    chosen = (o for o in itertools.product((-1, 0, 1), repeat=k) if not half or o >= (0,) * k)
    steps = ", ".join(f"array({', '.join(f'{s}L' for s in o)})" for o in chosen)
    stepped = df.withColumn("_step", F.explode(F.expr(f"array({steps})")))
    return stepped.withColumn(out, F.array(*(F.col(cell)[i] + F.col("_step")[i] for i in range(k)))).drop("_step")


def _to_boxes(rows: DataFrame, boxes: DataFrame, n_boxes: int, on: str) -> DataFrame:
    """Join exploded rows to boxes. Spark underrates exploded rows, so the side to broadcast, if any, is named here."""
    return rows.join(F.broadcast(boxes) if n_boxes <= BROADCAST_ROWS else boxes.hint("merge"), on)


def _fan_out(boxes: DataFrame) -> DataFrame:
    """Spread a small table whose rows are about to be multiplied, a task per core."""
    return boxes.repartition(boxes.sparkSession.sparkContext.defaultParallelism, "cell")


def _clique_level(k: int) -> int:
    """First level at which two cells with a common face, and so one cell, have all their points within eps."""
    level = 0
    while math.sqrt(k + 3) / 2**level >= 0.999:
        level += 1
    return level


def _sites(points: DataFrame, key: str, col: str) -> DataFrame:
    """Distinct positions ``x`` with their number of points ``w``; ``sid`` is the smallest key there."""
    x = F.transform(F.col(col), lambda v: v.cast("double") + F.lit(0.0))  # -0.0 becomes 0.0
    return points.select(F.col(key).alias("sid"), x.alias("x")).groupBy("x").agg(
        F.min("sid").alias("sid"), F.count(F.lit(1)).alias("w")
    )


# -- clustering ----------------------------------------------------------------------------------------------------


def dense_cells(sites: DataFrame, eps: float, min_samples: int, k: int) -> DataFrame:
    """Small cells with ``min_samples`` points in themselves and the touching small cells wholly within ``eps`` of them."""
    tight = stage(_boxes(sites, eps, _clique_level(k), k))
    few = _side(_fan_out(tight.filter(F.col("w") < min_samples)), "a")
    around = _to_boxes(_touching(few, "cell_a", "cell_b", k), _side(tight, "b"), tight.count(), "cell_b")
    close = _judged(around, eps, k).filter("joined").groupBy("cell_a").agg(F.sum("w_b").alias("close"))
    close = close.filter(F.col("close") >= min_samples).select(F.col("cell_a").alias("cell"))
    return stage(tight.filter(F.col("w") >= min_samples).select("cell").unionByName(close))


def core_sites(sites: DataFrame, eps: float, min_samples: int, k: int) -> DataFrame:
    """Positions with at least ``min_samples`` points within ``eps``."""
    eps2 = F.lit(eps * eps)
    clique = _clique_level(k)
    cells = sites.withColumn("cell", _cell(F.col("x"), eps, clique))
    dense = dense_cells(sites, eps, min_samples, k)
    sure = cells.join(dense, "cell", "left_semi").select("sid", "x", "w")
    # Fewer than min_samples points per small cell and its close neighbours are left to test, however dense the data is.
    tested = stage(cells.join(dense, "cell", "left_anti").select("sid", "x", "w"))

    boxes = stage(_boxes(sites, eps, 0, k))
    here = _boxes(tested, eps, 0, k).select("cell", F.col("lo").alias("lo_h"), F.col("hi").alias("hi_h"))
    around = _touching(_fan_out(here), "cell", "other", k)
    around = _to_boxes(around, boxes.withColumnsRenamed({"cell": "other", "w": "bw"}), boxes.count(), "other")
    around = around.filter(_near2(*(F.col(c) for c in ("lo_h", "hi_h", "lo", "hi")), k) <= eps2)
    around = stage(around.drop("lo_h", "hi_h"))
    open_ = (
        tested.select("sid", "x", _cell(F.col("x"), eps, 0).alias("cell"))
        .join(around, "cell")
        .select("sid", "x", F.col("other").alias("cell"), "lo", "hi", "n", "bw")
    )
    counts = tested.select("sid", F.lit(0).cast("bigint").alias("c"))
    level = 0
    while True:
        near = open_.withColumn("d", _near2(F.col("x"), F.col("x"), F.col("lo"), F.col("hi"), k)).filter(
            F.col("d") <= eps2
        )
        inside = _far2(F.col("x"), F.col("x"), F.col("lo"), F.col("hi"), k) <= eps2
        near = stage(near.withColumn("inside", inside).drop("d"))
        whole = near.filter("inside").select("sid", F.col("bw").alias("c"))
        members = sites.select(
            _cell(F.col("x"), eps, level).alias("cell"), F.col("x").alias("y"), F.col("w").alias("yw")
        )
        leaf = near.filter(~F.col("inside") & (F.col("n") <= LEAF)).join(members, "cell")
        single = leaf.filter(_dist2(F.col("x"), F.col("y"), k) <= eps2).select("sid", F.col("yw").alias("c"))
        counts = stage(
            counts.unionByName(whole).unionByName(single).groupBy("sid").agg(F.sum("c").alias("c"))
        )
        reached = counts.filter(F.col("c") >= min_samples)
        deeper = near.filter(~F.col("inside") & (F.col("n") > LEAF)).join(reached.select("sid"), "sid", "left_anti")
        deeper = deeper.select("sid", "x", F.col("cell").alias("parent"))
        if deeper.isEmpty():
            break
        level += 1
        children = _boxes(sites, eps, level, k).withColumn("parent", _parent(F.col("cell")))
        open_ = deeper.join(children.withColumnRenamed("w", "bw"), "parent").drop("parent")
    found = tested.join(reached.select("sid"), "sid", "left_semi")
    return stage(sure.unionByName(found.select("sid", "x", "w")))


def linked_cells(core: DataFrame, eps: float, k: int) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of the small cells of the core positions; not every linked pair is one.

    Cells are named by the smallest ``sid`` they hold; all core positions of one small cell belong together. Touching
    small cells are linked first. The component that this gives a small cell travels up into the boxes of wider cells,
    and a pair of boxes is opened only while the two may still hold different components: the inside of a dense region,
    however many pairs of cells it has within ``eps``, opens nothing. Two boxes wholly within ``eps`` are linked by the
    names of their cells, and each of their small cells to those.
    """
    clique = _clique_level(k)
    small = _cell(F.col("x"), eps, clique)
    tight = stage(_boxes(core, eps, clique, k, name="sid"))
    touching = _touching(_side(_fan_out(tight), "a"), "cell_a", "cell_b", k, half=True).filter("cell_a < cell_b")
    touching = _judged(_to_boxes(touching, _side(tight, "b"), tight.count(), "cell_b"), eps, k).filter("joined")
    links = stage(touching.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")))
    names = tight.select("cell", "name")
    rooted = stage(_rooted(core.withColumn("small", small).join(names.withColumnRenamed("cell", "small"), "small"), links))
    # From here on a component is a star around its root, which keeps later rounds few.
    star = F.col("root").alias("a"), F.col("name").alias("b")
    links = rooted.select(*star).filter("a != b").distinct()

    pairs = None
    for level in range(clique + 1):
        boxes = stage(_boxes(rooted, eps, level, k, name="name", root=True).withColumn("parent", _parent(F.col("cell"))))
        if pairs is None:
            around = _touching(_side(_fan_out(boxes.drop("parent")), "a"), "cell_a", "cell_b", k, half=True)
            opened = _to_boxes(around, _side(boxes.drop("parent"), "b"), boxes.count(), "cell_b")
        else:
            opened = _opened(pairs, boxes).filter("parent_a != parent_b or cell_a <= cell_b")
        judged = stage(_judged(opened.filter(_APART), eps, k))
        settled = judged.filter("joined")
        across = settled.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).filter("a != b")
        links = links.unionByName(across)
        if level < clique:
            ends = [settled.select(F.col(f"cell_{s}").alias("cell"), F.col(f"name_{s}").alias("a")) for s in "ab"]
            ends = ends[0].unionByName(ends[1]).distinct()
            inside = rooted.select(_cell(F.col("x"), eps, level).alias("cell"), F.col("name").alias("b")).distinct()
            links = links.unionByName(inside.join(ends, "cell").select("a", "b").filter("a != b"))
        pairs = judged.filter("not joined").select("cell_a", "cell_b")

    # Pairs of small cells that hold different components so far and lie neither within nor beyond eps as a whole.
    while True:
        boxes = _boxes(rooted, eps, level, k, name="name", root=True)
        unsure = pairs.join(_side(boxes, "a"), "cell_a").join(_side(boxes, "b"), "cell_b").filter(_APART)
        unsure = stage(unsure.select("cell_a", "cell_b", "n_a", "n_b", "name_a", "name_b"))
        few = F.col("n_a") * F.col("n_b") <= LEAF * LEAF
        members = rooted.select(_cell(F.col("x"), eps, level).alias("cell"), "x", "name")
        leaf = unsure.filter(few).select("cell_a", "cell_b").join(_side(members, "a"), "cell_a")
        leaf = leaf.join(_side(members, "b"), "cell_b").filter(_dist2(F.col("x_a"), F.col("x_b"), k) <= F.lit(eps * eps))
        links = links.unionByName(leaf.select(F.col("name_a").alias("a"), F.col("name_b").alias("b")).distinct())
        pairs = unsure.filter(~few).select("cell_a", "cell_b")
        if pairs.isEmpty():
            return stage(links)
        rooted = stage(_rooted(rooted.drop("root"), stage(links)))
        links = rooted.select(*star).filter("a != b").distinct()
        level += 1
        boxes = stage(_boxes(rooted, eps, level, k, name="name", root=True).withColumn("parent", _parent(F.col("cell"))))
        judged = stage(_judged(_opened(pairs, boxes), eps, k))
        across = judged.filter("joined").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))
        links = links.unionByName(across)
        pairs = judged.filter("not joined").select("cell_a", "cell_b")


# Two boxes that may hold positions of different components.
_APART = "not (root_a = last_a and root_b = last_b and root_a = root_b)"


def _side(boxes: DataFrame, s: str) -> DataFrame:
    return boxes.select(*(F.col(c).alias(f"{c}_{s}") for c in boxes.columns))


def _judged(pairs: DataFrame, eps: float, k: int) -> DataFrame:
    """Pairs of boxes that are not wholly beyond ``eps``, with ``joined`` where they are wholly within."""
    boxes = [F.col(c) for c in ("lo_a", "hi_a", "lo_b", "hi_b")]
    near = pairs.filter(_near2(*boxes, k) <= F.lit(eps * eps))
    return near.withColumn("joined", _far2(*boxes, k) <= F.lit(eps * eps))


def _opened(pairs: DataFrame, boxes: DataFrame) -> DataFrame:
    """The pairs of child boxes of pairs of cells."""
    parents = _fan_out(pairs.withColumn("cell", F.col("cell_a"))).select(
        F.col("cell_a").alias("parent_a"), F.col("cell_b").alias("parent_b")
    )
    return parents.join(_side(boxes, "a"), "parent_a").join(_side(boxes, "b"), "parent_b")


def _rooted(named: DataFrame, links: DataFrame) -> DataFrame:
    """Add the component ``root`` of each position's small cell."""
    roots = components(links)
    return named.join(roots, F.col("name") == F.col("v"), "left").withColumn("root", F.coalesce("root", "name")).drop("v")


def components(edges: DataFrame) -> DataFrame:
    """``(v, root)`` for every end of an edge ``(a, b)``: the smallest id it is connected to.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges stop changing; every step is a
    minimum per vertex, combined before its shuffle, and a join back on the vertex.
    """

    def stars(pairs: DataFrame, towards_larger: bool) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = pairs.join(low, "u")
        moved = joined.filter("v > u") if towards_larger else joined
        return moved.select(F.col("v").alias("u"), F.col("m").alias("v"))

    current = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stars(both, True)
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("v"))
        small = stars(large, False).filter("u != v").unionByName(low).distinct()
        current = stage(small)
        check = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if check == seen:
            break
        seen = check
    roots = current.select(F.col("u").alias("v"), F.col("v").alias("root"))
    own = current.select(F.col("v"), F.col("v").alias("root")).distinct()
    return roots.unionByName(own)


def cluster_core(
    points: DataFrame,
    eps: float,
    min_samples: int = 25,
    min_cluster_size: int = 250,
    dims: int = 5,
    key: str = "post_id",
    col: str = "point",
) -> DataFrame:
    """Clustered core positions ``(sid, x, w, topic)``, topics numbered by size from 0."""
    sites = stage(_sites(points, key, col))
    core = core_sites(sites, eps, min_samples, dims)
    cell = _cell(F.col("x"), eps, _clique_level(dims))
    named = core.withColumn("cell", cell)
    names = named.groupBy("cell").agg(F.min("sid").alias("name"))
    roots = components(linked_cells(core, eps, dims))
    rooted = named.join(names, "cell").join(roots, F.col("name") == F.col("v"), "left")
    rooted = rooted.select("sid", "x", "w", F.coalesce("root", "name").alias("root"))
    sizes = rooted.groupBy("root").agg(F.sum("w").alias("size")).filter(F.col("size") >= min_cluster_size)
    kept = rooted.join(sizes, "root")
    order = kept.groupBy("root", "size").agg(F.min("sid").alias("first"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("size").desc(), "first")) - 1
    topics = order.select("root", place.cast("int").alias("topic"))  # one row per cluster
    return stage(kept.join(topics, "root").select("sid", "x", "w", "topic"))


def density_cluster(
    points: DataFrame,
    eps: float,
    min_samples: int = 25,
    min_cluster_size: int = 250,
    dims: int = 5,
    key: str = "post_id",
    col: str = "point",
) -> DataFrame:
    """``(key, topic)`` for every point; -1 is noise."""
    return label_points(points, cluster_core(points, eps, min_samples, min_cluster_size, dims, key, col), key, col)


def label_points(points: DataFrame, core: DataFrame, key: str = "post_id", col: str = "point") -> DataFrame:
    """``(key, topic)`` of the points that ``cluster_core`` was run on."""
    x = F.transform(F.col(col), lambda v: v.cast("double") + F.lit(0.0))
    return (
        points.select(key, x.alias("x"))
        .join(core.select("x", "topic"), "x", "left")
        .select(key, F.coalesce("topic", F.lit(-1)).alias("topic"))
    )


# -- further points ------------------------------------------------------------------------------------------------


def assign_topics(
    points: DataFrame,
    core: DataFrame,
    eps: float,
    dims: int = 5,
    key: str = "post_id",
    col: str = "point",
) -> DataFrame:
    """``(key, topic)`` of new points: the topic of the nearest clustered core position within ``eps``, else -1.

    ``core`` comes from ``cluster_core`` on the sample and is small next to ``points``. Two look-ups settle most points
    where they are read: no core position around (noise), or one topic around and a core position in the point's own
    small cell. Only points on the border of a cluster are compared with boxes. The smaller topic wins ties.
    """
    k, eps2 = dims, F.lit(eps * eps)
    clique = _clique_level(k)
    boxes = stage(_boxes(core, eps, 0, k, ["topic"]))
    width = eps * (1 + SLACK)
    lo_h = [F.col("here")[i] * F.lit(width) for i in range(k)]
    hi_h = [(F.col("here")[i] + 1) * F.lit(width) for i in range(k)]
    reachable = _near2(lo_h, hi_h, F.col("lo"), F.col("hi"), k) <= eps2 * (1 + 1e-6)  # a margin for rounding
    targets = _touching(_fan_out(boxes), "cell", "here", k).filter(reachable).drop("w")
    around = stage(targets.groupBy("here").agg(F.min("topic").alias("first"), F.max("topic").alias("last")))
    own = stage(core.select(_cell(F.col("x"), eps, clique).alias("own"), F.col("topic").alias("own_topic")).distinct())

    x = F.transform(F.col(col), lambda v: v.cast("double") + F.lit(0.0))
    placed = points.select(F.col(key).alias("id"), x.alias("x"))
    placed = placed.withColumns({"here": _cell(F.col("x"), eps, 0), "own": _cell(F.col("x"), eps, clique)})
    placed = _look_up(_look_up(placed, around, "here"), own, "own")
    alone = (F.col("first") == F.col("last")) & F.col("own_topic").isNotNull()
    quick = F.when(F.col("first").isNull(), -1).when(alone, F.col("first"))
    placed = stage(placed.select("id", "x", "here", quick.alias("topic")))
    border = placed.filter("topic is null").select("id", "x", "here")

    targets = targets.join(border.select("here").distinct(), "here", "left_semi")
    rows = _reaching(border.join(targets.hint("merge"), "here").drop("here"), k).filter(F.col("near") <= eps2)
    level = 0
    answers: DataFrame | None = None
    while True:
        rows = stage(rows)
        # Numbers per point, combined before the shuffle, however many boxes lie around it.
        state = rows.groupBy("id").agg(
            F.min("far").alias("reach"),
            F.min("topic").alias("first"),
            F.max("topic").alias("last"),
            F.max("n").alias("most"),
            F.min(F.struct("near", "topic")).alias("nearest"),
        )
        sure = F.when((F.col("first") == F.col("last")) & (F.col("reach") <= eps2), F.col("first"))
        sure = sure.when(F.col("most") == 1, F.col("nearest.topic"))
        state = stage(state.select("id", "reach", sure.alias("answer")))
        done = state.filter("answer is not null").select("id", F.col("answer").alias("topic"))
        answers = done if answers is None else answers.unionByName(done)
        left = rows.join(state.filter("answer is null").select("id", "reach"), "id").filter("near <= reach")
        left = left.select("id", "x", "topic", "cell", "lo", "hi", "n", "reach")
        if left.isEmpty():
            break
        # Single positions stay; small cells become their positions; the others their child cells.
        members = core.select(_cell(F.col("x"), eps, level).alias("cell"), "topic", F.col("x").alias("y"))
        single = left.filter("n = 1")
        leaf = left.filter((F.col("n") > 1) & (F.col("n") <= LEAF)).drop("lo", "hi", "n").join(members, ["cell", "topic"])
        leaf = leaf.withColumns({"lo": F.col("y"), "hi": F.col("y"), "n": F.lit(1).cast("bigint")}).drop("y")
        children = _boxes(core, eps, level + 1, k, ["topic"]).withColumn("parent", _parent(F.col("cell"))).drop("w")
        deeper = left.filter(F.col("n") > LEAF).select("id", "x", "topic", F.col("cell").alias("parent"), "reach")
        deeper = deeper.join(children, ["parent", "topic"]).drop("parent")
        rows = single.unionByName(leaf).unionByName(deeper)
        rows = _reaching(rows, k).filter(F.col("near") <= F.least(F.col("reach"), eps2)).drop("reach")
        level += 1
    # A point whose last box turned out to be too far has no answer: noise.
    border = border.select("id").join(answers, "id", "left").select("id", F.coalesce("topic", F.lit(-1)).alias("topic"))
    settled = placed.filter("topic is not null").select("id", "topic")
    return settled.unionByName(border).withColumnRenamed("id", key)


def _look_up(rows: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Left join with a stored table that is broadcast while its counted size allows."""
    few = small.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(small) if few else small.hint("merge"), on, "left")


def _reaching(rows: DataFrame, k: int) -> DataFrame:
    """Add the squared distances of ``x`` to the nearest and the farthest corner of the box."""
    box = (F.col("x"), F.col("x"), F.col("lo"), F.col("hi"))
    return rows.withColumns({"near": _near2(*box, k), "far": _far2(*box, k)})
