"""Command line: cluster a dataset or a points file, and explore parameters of DBSCAN.

    python -m quernel.cli --alg-name kmeans-naive --dataset onlineretail --numK 4 --epsilon 1e-4 --data /path/of/tables
    python -m quernel.cli --alg-name dbscan --file points.csv --epsilon 0.3 --minpts 5 --out result
    python -m quernel.cli time --file points.csv --repeats 10
    python -m quernel.cli nn-hist --file points.csv --numBuckets 16
    python -m quernel.cli neighbor-hist --file points.csv --epsilon 0.3
"""

from __future__ import annotations

import argparse
import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.functions import stats
from quernel.operators import dbscan, epsjoin, features, kmeans, plotdata, summary, svg
from quernel.plans.lineage import stored
from quernel.sources import tables
from quernel.sources.files import read_points
from quernel.sources.sinks import write_clusters, write_csv, write_histogram, write_lines

ALGORITHMS = ("kmeans-naive", "kmeans", "scalable-kmeans", "dbscan")
DATASETS = ("onlineretail", "instacart", "multicatshop")
RFM = ["recency", "frequency", "monetary"]


@contextmanager
def timed(what: str) -> Iterator[None]:
    start = time.perf_counter()
    yield
    print(f"{what}: {(time.perf_counter() - start) * 1000:.0f} ms")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", nargs="?", default="cluster", choices=("cluster", "dbscan", "time", "nn-hist", "neighbor-hist"))
    p.add_argument("--alg-name", choices=ALGORITHMS, default="kmeans-naive")
    p.add_argument("--dataset", choices=DATASETS, default="onlineretail")
    p.add_argument("--data", help="folder of the tables, for --dataset")
    p.add_argument("--paths", help="JSON file that names the folder of each dataset, instead of --data")
    p.add_argument("--file", help="CSV of points, instead of a dataset")
    p.add_argument("--numK", type=int, default=4)
    p.add_argument("--epsilon", "--eps", type=float, default=1e-4, help="stopping threshold of k-means, radius of DBSCAN")
    p.add_argument("--minpts", "--minPts", "--numPts", type=int, default=3)
    p.add_argument("--distanceMeasure", default="euclidean")
    p.add_argument("--borderPointsAsNoise", action="store_true")
    p.add_argument("--numBuckets", type=int, default=16)
    p.add_argument("--make-plot", choices=("true", "false"), default="false", help="write the frame behind the pair plot, and the plots as SVG")
    p.add_argument("--elbow", action="store_true", help="write k and squared error for k from 2 to 10")
    p.add_argument("--repeats", type=int, default=10, help="fits for each k of the command `time`")
    p.add_argument("--debugOutput", help="folder for the frames between the steps of DBSCAN")
    p.add_argument("--out", help="folder for the results")
    return p


def load(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, list[str]]:
    """Points with an id, and their features: of a file as they are, of a dataset log-scaled and standardised."""
    if args.file:
        found = read_points(spark, args.file)
        return found, [c for c in found.columns if c != "id"]
    if args.paths:  # read by Spark, so that it may lie in any store
        args.data = dict(json.loads("\n".join(r[0] for r in spark.read.text(args.paths, wholetext=True).collect()))).get(args.dataset)
    if not args.data:
        raise SystemExit("--dataset needs the folder of its tables, by --data or --paths")
    if args.dataset == "onlineretail":
        rfm = features.retail_rfm(tables.retail_lines(spark, args.data)).withColumnRenamed("customer_id", "id")
    elif args.dataset == "multicatshop":
        rfm = features.events_rfm(tables.shop_events(spark, args.data)).withColumnRenamed("user_id", "id")
    else:
        lines = tables.basket_lines(spark, args.data, reordered=False)
        per_order = features.products_per_order(lines.where("eval_set = 'prior'"), lines.where("eval_set = 'train'"))
        rfm = features.basket_rfm(features.basket_typed(tables.basket_orders(spark, args.data)), per_order).withColumnRenamed("user_id", "id")
    return stats.std_scale(stats.log_scale(rfm, RFM), RFM), RFM


def cluster(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    points, names = load(spark, args)
    if args.alg_name == "dbscan" or args.command == "dbscan":
        params = dbscan.DbscanParams(args.epsilon, args.minpts, args.distanceMeasure, args.borderPointsAsNoise)
        return dbscan.fit(points, names, params, debug_path=args.debugOutput).labelled
    if args.alg_name == "kmeans-naive":
        model = kmeans.fit(points, names, args.numK, args.epsilon)
        kmeans.wssse(points, model).show()
        return model.assign(points)
    mode = "random" if args.alg_name == "kmeans" else "k-means||"
    return kmeans.library_fit(points, names, args.numK, args.epsilon, mode)[1]


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quernel").getOrCreate()
    points, names = load(spark, args)
    if args.command == "time":
        took = kmeans.timing(points, names, range(2, 11), args.repeats, args.epsilon, args.alg_name != "kmeans-naive")
        for k, ms in took:
            print(f"k = {k}: {ms} ms")
        if args.out:
            write_lines(spark.createDataFrame([(f"{k},{ms}",) for k, ms in took], "line string"), f"{args.out}/timing", "line")
        return
    if args.command == "nn-hist":
        found = stats.histogram(epsjoin.nearest_distance(points, names, distance=args.distanceMeasure), "dist", args.numBuckets)
    elif args.command == "neighbor-hist":
        near = epsjoin.neighbour_counts(points, names, args.epsilon, distance=args.distanceMeasure)
        found = stats.histogram(near, "n", args.numBuckets)
    else:
        with timed(args.alg_name):
            labelled = cluster(spark, args)
            labelled.groupBy("cluster").agg(F.count("*").alias("n")).orderBy("cluster").show(100)
        table = summary.grouped_describe(labelled, "cluster", names)
        table.orderBy("feature", "cluster").show(200)
        if args.out:
            write_clusters(labelled, f"{args.out}/clusters", names)
            write_csv(table, f"{args.out}/summary", single=True)
            if args.make_plot == "true":
                plotdata.pairs(labelled, names).write.mode("overwrite").parquet(f"{args.out}/pairs")
                for x, y in combinations(names, 2):
                    svg.save(labelled, svg.scatter(labelled, x, y), f"{args.out}/plots/{x}-{y}")
            if args.elbow:
                line = stored(plotdata.elbow_line(kmeans.elbow(points, names, range(2, 11), args.epsilon)), "elbow-line")
                write_csv(line, f"{args.out}/elbow", single=True)
                if args.make_plot == "true":
                    svg.save(line, svg.line_chart(line, "squared error by k"), f"{args.out}/plots/elbow")
        return
    found.orderBy("lo").show(args.numBuckets)
    if args.out:
        write_histogram(found, f"{args.out}/histogram")
        if args.make_plot == "true":
            shown = found.orderBy("lo").select(F.round("lo", 4).cast("string").alias("label"), F.col("n").alias("height"))
            svg.save(found, svg.bar_chart(shown, args.command), f"{args.out}/plots/histogram")


if __name__ == "__main__":
    main()
