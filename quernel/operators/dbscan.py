"""DBSCAN as set operations, with the same result wherever rows lie.

A point with at least `min_points` points within eps, itself included, is a core point. Core points within eps of each
other are one cluster. Any other point within eps of a core point belongs to the cluster of the smallest label among those,
or is noise if borders count as noise. Labels are dense numbers from 1, in order of the clusters' smallest core ids.

Points lie in cells so small that all points of one are within eps of each other, and no pair of points is ever stored: what is
stored grows with the points and the cells around each, however dense they lie.

1. A cell with `min_points` points holds core points only. A point of another cell counts the points of the cells around it: those of
   a cell that lies within eps as a whole by the cell's count, others one by one, summed where the join meets them.
2. Core points of a cell are one cluster. Two cells are linked if their boxes lie within eps as a whole, or two of their
   outermost core points do. Only pairs of cells that are still in different clusters then are compared point by point, and
   a point leaves the comparison at its first neighbour.
3. Border points lie in cells with fewer than `min_points` points; each looks for a core point in the cells around it.
4. New points share cells in the same way. What lies within eps of a cell as a whole, and what can lie there at most, settles most
   cells; points of the others count the members of those clusters that can still change their label, by boxes of members that are
   halved until few pairs are left to compare.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.distance import box_bounds, grid, metric
from quernel.functions.ranks import running_sum
from quernel.plans.lineage import stored
from quernel.sources.sinks import debug_dump

from .components import components
from .epsjoin import GRID, eps_pairs

#: Ids that aren't clusters.
NOISE, NEW_CLUSTER, UNDEFINED = 0, -1, -2
#: For a prediction: pairs compared one by one for each place, in the mean; while there are more, groups are halved, so often at most.
COMPARED, SPLITS = 16, 16


@dataclass(frozen=True)
class DbscanParams:
    eps: float = 1e-4
    min_points: int = 3
    distance: str = "euclidean"
    border_as_noise: bool = False


class DbscanModel:
    """Points with their cluster."""

    def __init__(self, labelled: DataFrame, features: list[str], params: DbscanParams, key: str = "id"):
        self.labelled, self.features, self.params, self.key = labelled, features, params, key

    def noise(self) -> DataFrame:
        return self.labelled.where(F.col("cluster") == NOISE)

    def clustered(self) -> DataFrame:
        return self.labelled.where(F.col("cluster") != NOISE)

    def sizes(self) -> DataFrame:
        return self.labelled.groupBy("cluster").agg(F.count("*").alias("n"))

    def number_of_clusters(self) -> DataFrame:
        return self.clustered().agg(F.count_distinct("cluster").alias("n_clusters"))

    def predict(self, new: DataFrame) -> DataFrame:
        """(id, cluster) of new points: a cluster with min_points - 1 members near; else any cluster near, if borders count;
        else a new cluster where min_points - 1 noise points are near; else noise. The smallest cluster wins ties. A row that
        lacks a feature is noise, and rows that share an id are points of their own."""
        p, space = self.params, _Space(len(self.features), self.params.eps, self.params.distance)
        new = stored(new.select(F.col(self.key).alias("id"), *space.values(self.features)), "predict-new")
        members = self.labelled.select(self.key, "cluster", *self.features).dropna().select("cluster", *space.values(self.features))
        members = space.placed(members.groupBy("cluster", *space.x).agg(F.count("*").alias("n")))
        places = space.placed(new.select(*space.x).dropna().distinct())
        found = _predicted(places, members, space, max(p.min_points - 1, 1), p.border_as_noise)
        return new.join(found, space.x, "left").select(F.col("id").alias(self.key), F.coalesce("cluster", F.lit(NOISE)).cast("int").alias("cluster"))


class _Space:
    """Cells, boxes and distances of `d` features, which frames hold as x0, x1, ...; a box is l0, h0, l1, h1, ..."""

    def __init__(self, d: int, eps: float, distance: str):
        self.d, self.eps, self.distance = d, eps, distance
        self.x, self.c = [f"x{i}" for i in range(d)], [f"c{i}" for i in range(d)]
        self.cell, self.reach = grid(distance, eps, d)
        self.axes = self.c[:GRID]

    def values(self, features: list[str]) -> list[Column]:
        return [F.col(f).cast("double").alias(x) for f, x in zip(features, self.x, strict=True)]

    def placed(self, points: DataFrame) -> DataFrame:
        return points.select("*", *[self.cell(F.col(x)).alias(c) for x, c in zip(self.x, self.c, strict=True)])

    def box(self) -> list[Column]:
        return [f(x).alias(f"{n}{i}") for i, x in enumerate(self.x) for f, n in ((F.min, "l"), (F.max, "h"))]

    def bounds(self, a: str, b: str) -> tuple[Column, Column]:
        """Bounds of the distance between the boxes of two sides of a join."""
        of = lambda s: [(F.col(f"{s}.l{i}"), F.col(f"{s}.h{i}")) for i in range(self.d)]
        return box_bounds(self.distance, of(a), of(b))

    def away(self, a: str, b: str) -> Column:
        return metric(self.distance)([F.col(f"{a}.{x}") for x in self.x], [F.col(f"{b}.{x}") for x in self.x])

    def shape(self) -> list[str]:
        """Columns of a cell's place and box."""
        return [*self.c, *[f"{n}{i}" for i in range(self.d) for n in "lh"]]

    def around(self, xs: DataFrame, ys: DataFrame, *more: str, apart: bool = True) -> DataFrame:
        """(x, y, whole, and columns of y as `more` names them): for every cell x of xs the cells y of ys whose box lies within
        eps of its own; `whole` says whether every point of the one is within eps of every point of the other. With `apart` a
        cell doesn't meet the one of its own name."""
        blocks = [F.floor(F.col(c) / self.reach).alias(f"k{i}") for i, c in enumerate(self.axes)]
        names = [f"k{i}" for i in range(len(blocks))]
        offsets = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, o, strict=True)]) for o in product((-1, 0, 1), repeat=len(names))])
        left = xs.select("*", *blocks).withColumn("_o", F.explode(offsets)).withColumns({n: F.col(n) + F.col(f"_o.{n}") for n in names})
        met = left.alias("x").join(ys.select("*", *blocks).alias("y"), reduce(lambda p, q: p & q, [F.col(f"x.{n}") == F.col(f"y.{n}") for n in names]))
        met = met.where("x.cell != y.cell") if apart else met
        near, far = self.bounds("x", "y")
        return met.where(near <= self.eps).select(F.col("x.cell").alias("x"), F.col("y.cell").alias("y"), (far <= self.eps).alias("whole"), *[F.col(f"y.{m}").alias(m) for m in more])


def _core(points: DataFrame, cells: DataFrame, space: _Space, least: int) -> DataFrame:
    """The points, with `core`."""
    near = stored(space.around(cells, cells, "n"), "dbscan-around")
    # cells that have too few points themselves, with what cells within eps as a whole add, and what others may add at most
    sums = near.groupBy("x").agg(F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).alias("sure"), F.sum(F.when(F.col("whole"), 0).otherwise(F.col("n"))).alias("maybe"))
    known = cells.join(sums, cells["cell"] == sums["x"], "left").select("cell", (F.col("n") + F.coalesce("sure", F.lit(0))).alias("sure"), F.coalesce("maybe", F.lit(0)).alias("maybe"))
    known = known.withColumn("core", F.when(F.col("sure") >= least, True).when(F.col("sure") + F.col("maybe") < least, False))
    points = stored(points.join(known.select("cell", "sure", "core"), "cell"), "dbscan-known")
    open_cells = near.where("not whole").join(known.where("core is null").select(F.col("cell").alias("x")), "x", "left_semi").select("x", "y")
    asks = points.where("core is null").join(open_cells, F.col("cell") == F.col("x")).select("id", "y", "sure", *space.x)
    met = asks.alias("a").join(points.alias("b"), F.col("a.y") == F.col("b.cell")).where(space.away("a", "b") <= space.eps)
    more = met.groupBy("a.id").agg((F.count("*") + F.first("a.sure")).alias("total")).where(F.col("total") >= least).select("id", F.lit(True).alias("_more"))
    return stored(points.join(more, "id", "left").select("id", "cell", *space.x, F.coalesce("core", "_more", F.lit(False)).alias("core")), "dbscan-points-core")


def _clusters(core: DataFrame, cells: DataFrame, space: _Space) -> DataFrame:
    """Every cell with core points, with the box of those and `label`, the smallest core id of its cluster."""
    point = F.struct("id", *space.x)
    outermost = [f(point, x) for x in space.x for f in (F.min_by, F.max_by)]
    rows = core.groupBy("cell").agg(F.min("id").alias("lead"), F.array_distinct(F.array(*outermost)).alias("outer"), *space.box())
    rows = stored(rows.join(cells.select("cell", *space.c), "cell"), "dbscan-core-cells")
    near = space.around(rows, rows, "lead", "outer").where("x < y").join(rows.select(F.col("cell").alias("x"), F.col("lead").alias("lead_x"), F.col("outer").alias("outer_x")), "x")
    apart = metric(space.distance)
    touch = F.exists("outer_x", lambda a: F.exists("outer", lambda b: apart([a[x] for x in space.x], [b[x] for x in space.x]) <= space.eps))
    near = stored(near.select("x", "y", F.col("lead_x").alias("a"), F.col("lead").alias("b"), (F.col("whole") | touch).alias("sure")), "dbscan-near")
    found = components(near.where("sure").select("a", "b"))
    label = stored(rows.join(found, rows["lead"] == found["node"], "left").select("cell", *space.shape(), F.coalesce("label", "lead").alias("label")), "dbscan-cells")
    side = lambda n: label.select(F.col("cell").alias(n), F.col("label").alias(f"label_{n}"))
    rest = stored(near.where("not sure").join(side("x"), "x").join(side("y"), "y").where("label_x != label_y").select("x", "y", "label_x", "label_y"), "dbscan-rest")
    if rest.isEmpty():
        return label
    # only core points of x that lie within eps of y's box can have a neighbour there
    boxes = rows.select("cell", *[f"{n}{i}" for i in range(space.d) for n in "lh"])
    reach = box_bounds(space.distance, [(F.col(x), F.col(x)) for x in space.x], [(F.col(f"l{i}"), F.col(f"h{i}")) for i in range(space.d)])[0]
    asks = core.join(rest, F.col("cell") == F.col("x")).drop("cell").join(boxes, F.col("y") == F.col("cell")).where(reach <= space.eps).select("y", "label_x", "label_y", *space.x)
    links = asks.alias("a").join(core.alias("b"), (F.col("a.y") == F.col("b.cell")) & (space.away("a", "b") <= space.eps), "left_semi").select(F.col("label_x").alias("a"), F.col("label_y").alias("b"))
    joined = components(links.distinct())
    moved = label.join(joined.withColumnRenamed("label", "_to"), F.col("label") == F.col("node"), "left")
    return stored(moved.select("cell", *space.shape(), F.coalesce("_to", "label").alias("label")), "dbscan-label")


def _reached(others: DataFrame, core: DataFrame, cells: DataFrame, label: DataFrame, space: _Space) -> DataFrame:
    """(id, label) of points that aren't core but within eps of a core point: the smallest label among those."""
    near = stored(space.around(cells.join(others.select("cell"), "cell", "left_semi"), label, "label"), "dbscan-around-core")
    own = label.select("cell", F.col("label").alias("own"))
    sure = near.where("whole").groupBy(F.col("x").alias("cell")).agg(F.min("label").alias("sure"))
    asks = others.join(near.where("not whole"), F.col("cell") == F.col("x")).select("id", "y", "label", *space.x)
    met = asks.alias("a").join(core.alias("b"), (F.col("a.y") == F.col("b.cell")) & (space.away("a", "b") <= space.eps), "left_semi").groupBy("id").agg(F.min("label").alias("met"))
    found = others.join(own, "cell", "left").join(sure, "cell", "left").join(met, "id", "left")
    return found.select("id", F.least("own", "sure", "met").alias("label")).where("label is not null")


def _predicted(places: DataFrame, members: DataFrame, space: _Space, least: int, border_as_noise: bool) -> DataFrame:
    """(features, cluster) of places, from members (features, cluster, n: points there): the smallest cluster with `least` points
    within eps, else the smallest with any unless borders are noise, else NEW_CLUSTER if noise has `least`, else NOISE."""
    # members of a cell and cluster are a group; cells and groups are stored with their numbers, so that those hold
    numbered = lambda df, name: stored(df.withColumn("cell", F.monotonically_increasing_id()), name)
    held_by = [F.sum("n").alias("n"), F.count("*").alias("m"), *space.box()]
    sides = [f"{n}{i}" for i in range(space.d) for n in "lh"]
    cells = numbered(places.groupBy(*space.c).agg(*space.box()), "predict-cells")
    members = stored(members, "predict-members")
    groups = numbered(members.groupBy(*space.c, "cluster").agg(*held_by), "predict-groups")
    near = stored(space.around(cells, groups, "cluster", "n", "m", apart=False), "predict-around")
    own, cluster, sure, most = F.col("cluster") != NOISE, F.col("cluster"), F.col("sure"), F.col("sure") + F.col("maybe")
    whole, other = F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("whole"), 0).otherwise(F.col("n"))).alias("maybe")
    borders, kinds = F.lit(not border_as_noise), ["full", "some", "fresh"]

    def outcome(sums: DataFrame, by: str) -> DataFrame:
        enough = sure >= least
        return sums.groupBy(by).agg(F.min(F.when(own & enough, cluster)).alias("full"), F.min(F.when(own & borders & (sure > 0), cluster)).alias("some"), F.max(F.when(~own & enough, NEW_CLUSTER)).alias("fresh"))

    def settled(known: DataFrame, sums: DataFrame) -> DataFrame:
        found = outcome(sums, "id").withColumnsRenamed({k: f"{k}_too" for k in kinds})
        return stored(known.join(found, "id", "left").select("id", *[F.least(k, f"{k}_too").alias(k) for k in kinds]), "predict-known")

    def changing(sums: DataFrame, known: DataFrame, by: str) -> DataFrame:
        """The sums whose open part can still change the label."""
        counts = (sure < least) & (most >= least)
        full = own & counts & (F.col("full").isNull() | (cluster < F.col("full")))
        some = own & borders & F.col("full").isNull() & (sure == 0) & (F.col("some").isNull() | (cluster < F.col("some")))
        fresh = ~own & counts & F.coalesce(*kinds).isNull()
        return sums.where("maybe > 0").join(known, by).where(full | some | fresh).select(by, "cluster", "sure")

    low, high = box_bounds(space.distance, [(F.col(x), F.col(x)) for x in space.x], [(F.col(f"l{i}"), F.col(f"h{i}")) for i in range(space.d)])
    asked = lambda df, name: stored(df.where(low <= space.eps).select("id", "cluster", "sure", "y", "n", "m", (high <= space.eps).alias("whole"), *space.x), name)
    sums = stored(near.groupBy("x", "cluster").agg(whole.alias("sure"), other), "predict-sums")
    known = stored(outcome(sums, "x"), "predict-known")
    places = stored(places.join(cells.select(*space.c, F.col("cell").alias("x")), space.c).select("x", *space.x).withColumn("id", F.monotonically_increasing_id()), "predict-places")
    boxes = groups.select(F.col("cell").alias("y"), *sides)
    asks = asked(near.where("not whole").drop("whole").join(changing(sums, known, "x"), ["x", "cluster"]).join(boxes, "y").join(places, "x"), "predict-asks")
    held = members.join(groups.select(*space.c, "cluster", F.col("cell").alias("y")), [*space.c, "cluster"]).select("y", "n", *space.x)
    known = places.join(known, "x", "left").select("id", *kinds)
    few = COMPARED * (places.count() + members.count())
    for split in range(SPLITS + 1):
        sums = stored(asks.groupBy("id", "cluster").agg((F.first("sure") + whole).alias("sure"), other), "predict-sums")
        known = settled(known, sums)
        asks = stored(asks.where("not whole").select("id", "cluster", "y", "m", *space.x).join(changing(sums, known, "id"), ["id", "cluster"]), "predict-open")
        if split == SPLITS or (asks.agg(F.sum("m")).first()[0] or 0) <= few:
            break
        # every group that is still asked is halved on each axis
        halves = [(F.col(x) > (F.col(f"l{i}") + F.col(f"h{i}")) / 2).alias(f"b{i}") for i, x in enumerate(space.x)]
        part = ["y", *[f"b{i}" for i in range(space.d)]]
        held = stored(held.join(asks.select("y").distinct(), "y", "left_semi").join(boxes, "y").select("y", "n", *space.x, *halves), "predict-halves")
        parts = numbered(held.groupBy(*part).agg(*held_by), "predict-parts")
        held = held.join(parts.select(*part, "cell"), part).select(F.col("cell").alias("y"), "n", *space.x)
        asks = asked(asks.drop("m").join(parts, "y").drop("y").withColumnRenamed("cell", "y"), "predict-asks")
        boxes = parts.select(F.col("cell").alias("y"), *sides)
    met = asks.alias("a").join(held.alias("b"), (F.col("a.y") == F.col("b.y")) & (space.away("a", "b") <= space.eps))
    known = settled(known, met.groupBy("a.id", "a.cluster").agg((F.sum("b.n") + F.first("a.sure")).alias("sure")))
    return places.join(known, "id").select(*space.x, F.coalesce(*kinds, F.lit(NOISE)).alias("cluster"))


def fit(points: DataFrame, features: list[str], params: DbscanParams, key: str = "id", debug_path: str | None = None) -> DbscanModel:
    """Labels every point. With `debug_path`, pairs (made for this only), core points, and labels before numbering are written below it."""
    points = stored(points.select(key, *features).dropna(), "dbscan-points")
    if debug_path:
        debug_dump(eps_pairs(points, features, params.eps, key, params.distance), debug_path, "pairs")
    space = _Space(len(features), params.eps, params.distance)
    placed = space.placed(points.select(F.col(key).alias("id"), *space.values(features)))
    cells = stored(placed.groupBy(*space.c).agg(F.min("id").alias("cell"), F.count("*").alias("n"), *space.box()), "dbscan-cells-all")
    placed = placed.join(cells.select(*space.c, "cell"), space.c).select("id", "cell", *space.x)
    placed = _core(placed, cells, space, params.min_points)
    core = placed.where("core")
    label = _clusters(core, cells, space)
    labels = core.join(label, "cell").select("id", "label")
    for name, frame in (("core", core.select("id")), ("core_labels", labels)):
        debug_dump(frame, debug_path, name)
    if not params.border_as_noise:
        labels = labels.unionByName(_reached(placed.where("not core").drop("core"), core, cells, label, space))
    number = running_sum(label.select("label", F.lit(1).alias("one")).distinct(), "label", "one", "before").select("label", (F.col("before") + 1).cast("int").alias("cluster"))
    labels = labels.join(number, "label").select(F.col("id").alias(key), "cluster")
    return DbscanModel(points.join(labels, key, "left").withColumn("cluster", F.coalesce("cluster", F.lit(NOISE))), features, params, key)


