"""Lloyd's k-means as DataFrame plans, and the library's k-means behind the same interface.

Points are frames of an id and feature columns. Centres are k rows of numbers: they live on the driver and enter the plans as
literals, so an iteration is one scan and one aggregation of k groups with map-side sums; the fits of several k go
in step, one scan a round for all of them. Start: the k points with the
smallest md5 of id and seed, which any SQL engine can repeat. Centres are rounded to DIGITS after each step for the same
reason. A cluster that loses all its points keeps its centre; iteration stops at `max_iter`, or when centres move less
than `tol` in the mean, and the newest centres are returned.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from math import dist
from time import perf_counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.plans.lineage import stored

DIGITS = 9


@dataclass
class KMeansModel:
    features: list[str]
    centres: list[list[float]]
    iterations: int = 0
    shift: float = 0.0

    def assign(self, points: DataFrame, name: str = "cluster", distance: str = "dist2") -> DataFrame:
        """Adds the nearest centre's number, the smallest of equals, and the squared distance to it."""
        return points.withColumn("_best", nearest(self.features, self.centres)).select("*", F.col("_best.cluster").alias(name), F.col("_best.d").alias(distance)).drop("_best")

    def frame(self, spark) -> DataFrame:
        rows = [(i, *map(float, c)) for i, c in enumerate(self.centres)]
        return spark.createDataFrame(rows, "cluster int, " + ", ".join(f"`{f}` double" for f in self.features))


def nearest(features: list[str], centres: list[list[float]]) -> Column:
    """A struct of the squared distance to the nearest centre and its number. As text: a tree of columns, node by node, takes
    longer to build than a round takes to run on small inputs."""
    far = (" + ".join(f"(`{f}` - ({float(x)!r}D)) * (`{f}` - ({float(x)!r}D))" for f, x in zip(features, c, strict=True)) for c in centres)
    return F.expr("array_min(array(" + ", ".join(f"named_struct('d', {d}, 'cluster', {i})" for i, d in enumerate(far)) + "))")


def initial(points: DataFrame, features: list[str], k: int, seed: int = 42, key: str = "id") -> list[list[float]]:
    """The k starting centres, by rank of md5(id:seed)."""
    rows = points.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).select(*features).limit(k).collect()
    if k < 1 or len(rows) < k:
        raise ValueError(f"k is {k}, and there are {len(rows)} points")
    return [[float(x) for x in r] for r in rows]


def steps(points: DataFrame, features: list[str], models: dict[int, list[list[float]]]) -> dict[int, list[list[float]]]:
    """For each k, the means of the points nearest to each of its centres. The points are read once."""
    best = F.array(*[F.struct(F.lit(k).alias("k"), nearest(features, c)["cluster"].alias("cluster")) for k, c in models.items()])
    found = points.select(*features, F.inline(best)).groupBy("k", "cluster").agg(*[F.round(F.avg(f), DIGITS).alias(f) for f in features]).collect()
    new = {k: [list(c) for c in centres] for k, centres in models.items()}
    for r in found:
        new[r["k"]][r["cluster"]] = [float(r[f]) for f in features]
    return new


def fit_all(points: DataFrame, features: list[str], ks: Iterable[int], tol: float = 1e-4, max_iter: int = 250, seed: int = 42, key: str = "id") -> dict[int, KMeansModel]:
    """A model for each k; those whose centres have come to rest sit out the later rounds."""
    points = stored(points.select(key, *features).dropna(), "kmeans-points")
    ks = sorted(set(ks))
    if ks and ks[0] < 1:
        raise ValueError(f"k is {ks[0]}")
    start = initial(points, features, ks[-1], seed, key) if ks else []
    models = {k: KMeansModel(features, start[:k]) for k in ks}
    moving = ks if max_iter > 0 else []
    while moving:
        moved = steps(points, features, {k: models[k].centres for k in moving})
        for k in moving:
            shift = sum(dist(a, b) for a, b in zip(models[k].centres, moved[k], strict=True)) / k
            models[k] = KMeansModel(features, moved[k], models[k].iterations + 1, shift)
        moving = [k for k in moving if models[k].shift >= tol and models[k].iterations < max_iter]
    return models


def fit(points: DataFrame, features: list[str], k: int, tol: float = 1e-4, max_iter: int = 250, seed: int = 42, key: str = "id") -> KMeansModel:
    return fit_all(points, features, [k], tol, max_iter, seed, key)[k]


def wssse(points: DataFrame, model: KMeansModel) -> DataFrame:
    """One row: the sum of squared distances to the nearest centre."""
    return model.assign(points).agg(F.round(F.sum("dist2"), 6).alias("wssse"))


def elbow(points: DataFrame, features: list[str], ks: range, tol: float = 1e-4, max_iter: int = 250, seed: int = 42, key: str = "id") -> DataFrame:
    """(k, wssse) for each k. The models are k rows each; the errors of all are summed in one pass."""
    points = stored(points.select(key, *features).dropna(), "elbow-points")
    models = fit_all(points, features, ks, tol, max_iter, seed, key)
    sums = points.agg(F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.sum(nearest(features, m.centres)["d"]), 6).alias("wssse")) for k, m in models.items()]).alias("rows"))
    return sums.select(F.inline("rows"))


def timing(points: DataFrame, features: list[str], ks: range, repeats: int = 10, tol: float = 1e-4, library: bool = False) -> list[tuple[int, int]]:
    """(k, mean milliseconds of a fit) for each k."""
    points = stored(points.dropna(subset=features), "timing-points")
    out = []
    for k in ks:
        start = perf_counter()
        for _ in range(repeats):
            library_fit(points, features, k, tol) if library else fit(points, features, k, tol)
        out.append((k, int((perf_counter() - start) * 1000 / repeats)))
    return out


def library_fit(points: DataFrame, features: list[str], k: int, tol: float = 1e-4, mode: str = "k-means||", max_iter: int = 250, seed: int = 4):
    """The library's k-means (`random` or `k-means||` start): (model, assembled and labelled points)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_features").transform(points.dropna(subset=features))
    model = KMeans(k=k, initMode=mode, maxIter=max_iter, tol=tol, seed=seed, featuresCol="_features", predictionCol="cluster").fit(rows)
    return model, model.transform(rows).drop("_features")


def project(points: DataFrame, features: list[str], dimensions: int = 2) -> DataFrame:
    """Principal components pc1, pc2, ... for plots."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=features, outputCol="_features").transform(points.dropna(subset=features))
    model = PCA(k=dimensions, inputCol="_features", outputCol="_pc").fit(rows)
    found = model.transform(rows).withColumn("_pc", vector_to_array("_pc"))
    return found.select(*points.columns, *[F.col("_pc")[i].alias(f"pc{i + 1}") for i in range(dimensions)])
