import math
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernel.functions import stats
from quernel.functions.distance import metric
from quernel.functions.ranks import running_sum
from quernel.operators import dbscan, eda, epsjoin, features, kmeans, plotdata, summary
from quernel.operators import components as components_module
from quernel.operators.components import components
from quernel.sources import files, sinks

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
RETAIL = "customer_id long, invoice long, stock_code long, description string, country string, line int, quantity string, price string, invoice_date timestamp"


def points(spark, rows, names=("x", "y")):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{n} double" for n in names))


def test_dirty_lines_are_cleaned(spark):
    day = datetime(2024, 1, 2)
    line = (1, 10, 5, "d", "c", 1, "2", "0.37", day)
    rows = [line, line, (None, *line[1:]), (*line[:6], "-1", "3", day), (*line[:6], "0", "3", day), (1, 11, 5, "d", "c", 1, "2", "abc", day)]
    clean = features.retail_clean(spark.createDataFrame(rows, RETAIL))
    assert sorted((r.invoice, r.amount) for r in clean.collect() if r.amount is not None) == [(10, 0.74)]
    assert clean.count() == 2


def test_one_invoice_has_recency_one(spark):
    rfm = features.retail_rfm(spark.createDataFrame([(1, 10, 5, "d", "c", 1, "2", "4", datetime(2024, 1, 2))], RETAIL)).first()
    assert (rfm.recency, rfm.frequency, rfm.monetary) == (1.0, 1, 8.0)
    assert features.retail_rfm(spark.createDataFrame([], RETAIL)).count() == 0


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, None)], "a double, b double")
    scaled = stats.std_scale(df, ["a", "b"]).collect()
    assert math.isclose(scaled[1].a - scaled[0].a, 1 / 1.5275252316519468) and [r.b for r in scaled] == [0.0, 0.0, None]
    z = stats.z_scale(df, ["a"]).agg(F.avg("a"), F.stddev_pop("a")).first()
    assert abs(z[0]) < 1e-12 and math.isclose(z[1], 1)
    logs = spark.createDataFrame([(-1.0,), (-2.0,), (0.0,)], "a double")
    assert [r.a for r in stats.log_scale(logs, ["a"]).collect()] == [None, None, 0.0]
    assert [r.a for r in stats.log_scale_sql(logs, ["a"]).collect()] == [None, None, 0.0]
    assert [r.b for r in stats.impute_mean(spark.createDataFrame([(1.0,), (2.0,), (None,)], "b double"), ["b"], 0).collect()] == [1.0, 2.0, 2.0]


@FEW
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=40), st.integers(1, 7))
def test_histogram_counts_every_value(spark, values, k):
    rows = stats.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v", k).collect()
    assert sum(r.n for r in rows) == len(values) and len(rows) == (1 if min(values) == max(values) else k)


@FEW
@given(st.lists(st.tuples(st.floats(-3, 3), st.floats(-3, 3)), min_size=1, max_size=25), st.sampled_from([0.1, 0.5, 1.0]), st.sampled_from(["euclidean", "manhattan", "chebyshev"]))
def test_grid_join_is_brute_force(spark, rows, eps, name):
    how = {"euclidean": lambda a, b: math.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1])), "manhattan": lambda a, b: abs(a[0] - b[0]) + abs(a[1] - b[1]), "chebyshev": lambda a, b: max(abs(a[0] - b[0]), abs(a[1] - b[1]))}[name]
    got = {(r.a, r.b) for r in epsjoin.eps_pairs(points(spark, rows), ["x", "y"], eps, distance=name).collect()}
    assert got == {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if how(rows[i], rows[j]) <= eps}


def test_pairs_at_cell_borders_and_bad_arguments(spark):
    df = points(spark, [(-0.5, 0), (0.0, 0), (0.5, 0), (1.0, 0)])
    assert {(r.a, r.b) for r in epsjoin.eps_pairs(df, ["x", "y"], 0.5).collect()} == {(0, 1), (1, 2), (2, 3)}
    with pytest.raises(ValueError):
        epsjoin.eps_pairs(df, ["x", "y"], 0)
    with pytest.raises(ValueError):
        epsjoin.eps_pairs(df, ["x", "y"], 1, distance="canberra")
    with pytest.raises(ValueError):
        metric("none")


def test_nearest_distance(spark):
    rows = [(0, 0), (0, 3), (100, 0), (0, 0)]
    assert {r.id: r.dist for r in epsjoin.nearest_distance(points(spark, rows), ["x", "y"]).collect()} == {0: 0.0, 1: 3.0, 2: 100.0, 3: 0.0}
    assert epsjoin.nearest_distance(points(spark, [(1, 1)]), ["x", "y"]).count() == 0
    assert [r.dist for r in epsjoin.nearest_distance(points(spark, [(1, 1), (1, 1)]), ["x", "y"]).collect()] == [0.0, 0.0]


def brute_dbscan(rows, eps, least, border_as_noise=False, how=math.dist):
    near = [[j for j in range(len(rows)) if how(rows[i], rows[j]) <= eps] for i in range(len(rows))]
    core = [len(n) >= least for n in near]
    label = {}
    for i in range(len(rows)):
        if core[i] and i not in label:
            todo = [i]
            label[i] = i
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and j not in label:
                        label[j] = i
                        todo.append(j)
    if not border_as_noise:
        for i in range(len(rows)):
            if not core[i] and any(core[j] for j in near[i]):
                label[i] = min(label[j] for j in near[i] if core[j])
    number = {v: k + 1 for k, v in enumerate(sorted(set(label.values())))}
    return {i: number[label[i]] if i in label else 0 for i in range(len(rows))}


@pytest.mark.parametrize("border", [False, True])
@pytest.mark.parametrize("in_task", [0, 1 << 20])
def test_dbscan_is_brute_force(spark, border, in_task, monkeypatch):
    monkeypatch.setattr("quernel.operators.components.IN_TASK", in_task)
    r = random.Random(4)
    rows = [(r.gauss(c, 0.4), r.gauss(c, 0.4)) for c in (0, 3) for _ in range(30)] + [(r.uniform(-4, 8), r.uniform(-4, 8)) for _ in range(20)]
    model = dbscan.fit(points(spark, rows), ["x", "y"], dbscan.DbscanParams(0.5, 4, border_as_noise=border))
    assert {x.id: x.cluster for x in model.labelled.collect()} == brute_dbscan(rows, 0.5, 4, border)
    assert model.noise().count() + model.clustered().count() == len(rows)


@pytest.mark.parametrize("name", ["manhattan", "chebyshev", "canberra"])
def test_dbscan_by_other_distances(spark, name):
    how = {"manhattan": lambda a, b: sum(map(abs, np.subtract(a, b))), "chebyshev": lambda a, b: max(map(abs, np.subtract(a, b))), "canberra": lambda a, b: sum(abs(x - y) / (abs(x) + abs(y)) if x or y else 0 for x, y in zip(a, b, strict=True))}[name]
    r = random.Random(6)
    rows = [(r.gauss(c, 0.5), r.gauss(-c, 0.5)) for c in (1, 4) for _ in range(30)] + [(r.uniform(-4, 8), r.choice([0, 1])) for _ in range(30)]
    eps = 0.4 if name == "canberra" else 0.6
    model = dbscan.fit(points(spark, rows), ["x", "y"], dbscan.DbscanParams(eps, 4, distance=name))
    assert {x.id: x.cluster for x in model.labelled.collect()} == brute_dbscan(rows, eps, 4, how=how)
    near = {x.id: x.n for x in epsjoin.neighbour_counts(points(spark, rows), ["x", "y"], eps, distance=name).collect()}
    assert near == {i: sum(how(a, b) <= eps for b in rows) for i, a in enumerate(rows)}
    far = {x.id: x.dist for x in epsjoin.nearest_distance(points(spark, rows), ["x", "y"], distance=name).collect()}
    assert far == pytest.approx({i: min(how(a, b) for j, b in enumerate(rows) if i != j) for i, a in enumerate(rows)})


def test_dense_points_are_stored_once(spark, monkeypatch):
    """20,000 points in one cell, and a ring of others around: what is written stays in proportion to the points."""
    written = []
    store = dbscan.stored

    def watched(df, name):
        out = store(df, name)
        written.append((name, out.count()))
        return out

    for module in (dbscan, components_module):
        monkeypatch.setattr(module, "stored", watched)
    r = random.Random(5)
    rows = [(r.uniform(0, 0.5), r.uniform(0, 0.5)) for _ in range(20_000)] + [(2 * math.cos(a), 2 * math.sin(a)) for a in range(60)]
    model = dbscan.fit(points(spark, rows), ["x", "y"], dbscan.DbscanParams(1.0, 5))
    got = {x.id: x.cluster for x in model.labelled.collect()}
    assert len({got[i] for i in range(20_000)}) == 1 and got[0] == 1 and max(n for _, n in written) <= 20_060, written
    assert [got[i] for i in range(20_000, 20_060)] == [brute_dbscan(rows[::200] + rows[20_000:], 1.0, 5)[i] for i in range(100, 160)]


def test_cells_that_only_points_can_link(spark):
    """Boxes that overlap within eps, and outermost points that are apart: points decide."""
    ring = [(0.35 * math.cos(a / 10), 0.35 * math.sin(a / 10)) for a in range(63)]
    rows = ring + [(x + 0.9, y + 0.1) for x, y in ring] + [(x + 0.1, y + 2.4) for x, y in ring] + [(1.2, 1.2)]
    for eps in (0.3, 0.55, 0.7):
        model = dbscan.fit(points(spark, rows), ["x", "y"], dbscan.DbscanParams(eps, 3))
        assert {x.id: x.cluster for x in model.labelled.collect()} == brute_dbscan(rows, eps, 3)


def test_nearest_distances_over_many_leaves(spark, monkeypatch):
    """Skewed places, an outlier that stretches every axis, and copies; also with a tree that saw next to nothing."""
    r = random.Random(8)
    rows = [(r.lognormvariate(0, 2), r.lognormvariate(0, 2)) for _ in range(1500)] + [(1e9, -1e9), (1e9 + 1, 1e9)]
    rows += rows[:20]
    x = np.array(rows)
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    monkeypatch.setattr(epsjoin, "LEAF", 16)
    for sampled in (64, 1):
        monkeypatch.setattr(epsjoin, "SAMPLED", sampled)
        got = {g.id: g.dist for g in epsjoin.nearest_distance(points(spark, rows).repartition(5), ["x", "y"]).collect()}
        assert got == pytest.approx(dict(enumerate(far.min(axis=1))))


def test_shared_border_point_does_not_merge(spark):
    rows = [(x, 0.0) for x in (0.0, 0.1, 0.2, 0.3, 1.2, 2.1, 2.2, 2.3, 2.4)]
    labels = {r.id: r.cluster for r in dbscan.fit(points(spark, rows), ["x", "y"], dbscan.DbscanParams(0.9, 4)).labelled.collect()}
    assert labels == brute_dbscan(rows, 0.9, 4) and len(set(labels.values())) == 2 and labels[4] == 1


def test_isolated_points_and_empty_table_are_noise(spark):
    model = dbscan.fit(points(spark, [(0, 0), (9, 9)]), ["x", "y"], dbscan.DbscanParams(1, 2))
    assert {r.cluster for r in model.labelled.collect()} == {0} and model.number_of_clusters().first()[0] == 0
    assert dbscan.fit(points(spark, []), ["x", "y"], dbscan.DbscanParams(1, 2)).labelled.count() == 0


def test_predict_outcomes(spark):
    rows = [(0, 0), (0, 0.1), (0.1, 0), (5, 5), (5, 5.8), (5.8, 5)]
    model = dbscan.fit(points(spark, rows), ["x", "y"], dbscan.DbscanParams(0.6, 3))
    new = points(spark, [(0, 0.05), (0.65, 0), (5.3, 5.3), (50, 50)])
    assert {r.id: r.cluster for r in model.predict(new).collect()} == {0: 1, 1: 1, 2: -1, 3: 0}


def brute_predict(rows, labels, new, eps, least, border_as_noise=False, how=math.dist):
    out = {}
    for i, a in enumerate(new):
        near = Counter(labels[j] for j, b in enumerate(rows) if how(a, b) <= eps)
        full = [c for c, n in near.items() if c and n >= least - 1]
        some = [c for c in near if c and not border_as_noise]
        out[i] = min(full or some or [-1 if near[0] >= max(least - 1, 1) else 0])
    return out


@pytest.mark.parametrize(("name", "eps", "least", "border"), [("euclidean", 0.5, 4, False), ("euclidean", 0.5, 4, True), ("euclidean", 0.35, 1, False), ("manhattan", 0.7, 9, False), ("chebyshev", 0.5, 6, False), ("canberra", 0.3, 8, True)])
def test_predict_is_brute_force(spark, name, eps, least, border):
    """Blobs whose edges meet, copies, noise, and new points between and far from all of them."""
    how = {
        "euclidean": math.dist, "manhattan": lambda a, b: sum(map(abs, np.subtract(a, b))), "chebyshev": lambda a, b: max(map(abs, np.subtract(a, b))),
        "canberra": lambda a, b: sum(abs(x - y) / (abs(x) + abs(y)) if x or y else 0 for x, y in zip(a, b, strict=True)),
    }[name]
    r = random.Random(11)
    rows = [(r.gauss(c, 0.4), r.gauss(c, 0.4)) for c in (0, 2, 4) for _ in range(40)] + [(r.uniform(-4, 8), r.uniform(-4, 8)) for _ in range(60)]
    rows += rows[100:130]
    new = [(r.uniform(-4, 8), r.uniform(-4, 8)) for _ in range(300)] + [(x + 0.15, y + 0.15) for x, y in rows] + [(0.0, 0.0), (1e6, -1e6)]
    model = dbscan.fit(points(spark, rows), ["x", "y"], dbscan.DbscanParams(eps, least, name, border))
    labels = {x.id: x.cluster for x in model.labelled.collect()}
    got = {x.id: x.cluster for x in model.predict(points(spark, new)).collect()}
    assert got == brute_predict(rows, labels, new, eps, least, border, how) and 0 in got.values() and max(got.values()) > 0


@pytest.mark.parametrize("splits", [2, 40])
def test_predict_by_halves_is_brute_force(spark, splits, monkeypatch):
    """Groups are halved twice and then compared, or until a box is a place; copies can't be halved."""
    monkeypatch.setattr(dbscan, "COMPARED", 0)
    monkeypatch.setattr(dbscan, "SPLITS", splits)
    r = random.Random(13)
    rows = [(c + r.uniform(0, 1), r.uniform(0, 1)) for c in (0, 2) for _ in range(150)] + [(r.uniform(-2, 5), r.uniform(-2, 3)) for _ in range(20)]
    rows += rows[:30]
    new = [(r.uniform(-1, 4), r.uniform(-1, 2)) for _ in range(400)]
    model = dbscan.fit(points(spark, rows), ["x", "y"], dbscan.DbscanParams(0.4, 6))
    labels = {x.id: x.cluster for x in model.labelled.collect()}
    assert {x.id: x.cluster for x in model.predict(points(spark, new)).collect()} == brute_predict(rows, labels, new, 0.4, 6)


def rows_moved(spark):
    """Rows written by all stages so far, to shuffles and files."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    found = [stages.apply(i) for i in range(stages.size())]
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() + s.outputRecords() for s in found}


def test_predict_moves_no_pairs(spark):
    """2,000 points in two dense clumps, and as many new ones beside: what moves between tasks grows with the points, not with the pairs."""
    spark = spark.newSession()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    r = random.Random(12)
    rows = [(c + r.uniform(0, 0.6), r.uniform(0, 0.6)) for c in (0, 3) for _ in range(1000)]
    new = [(x + 0.5, y) for x, y in rows]
    model = dbscan.fit(points(spark, rows), ["x", "y"], dbscan.DbscanParams(1.0, 5))
    labels = {x.id: x.cluster for x in model.labelled.collect()}
    before = rows_moved(spark)
    got = {x.id: x.cluster for x in model.predict(points(spark, new)).collect()}
    moved = sum(n for k, n in rows_moved(spark).items() if k not in before)
    assert got == brute_predict(rows, labels, new, 1.0, 5) and set(got.values()) == {1, 2}
    assert moved < 60 * len(rows), moved


def test_predict_keeps_every_row(spark):
    """Rows that share an id are points of their own, and rows that lack a feature are noise."""
    model = dbscan.fit(points(spark, [(0, 0), (0, 0.1), (0.1, 0), (9, 9), (9, 9.1), (9.1, 9)]), ["x", "y"], dbscan.DbscanParams(0.6, 3))
    new = spark.createDataFrame([(7, 0.0, 0.0), (7, 9.0, 9.0), (7, 9.0, 9.0), (8, None, 0.0), (9, float("nan"), 0.0), (10, -0.0, 0.0)], "id long, x double, y double")
    assert sorted((r.id, r.cluster) for r in model.predict(new).collect()) == [(7, 1), (7, 2), (7, 2), (8, 0), (9, 0), (10, 1)]
    assert model.predict(new.limit(0)).count() == 0
    nothing = dbscan.fit(points(spark, []), ["x", "y"], dbscan.DbscanParams(0.6, 3))
    assert {r.cluster for r in nothing.predict(new).collect()} == {0}


def test_kmeans_recovers_blobs(spark):
    r = random.Random(1)
    rows = [(c[0] + r.uniform(-1, 1), c[1] + r.uniform(-1, 1)) for c in ((0, 0), (20, 0), (0, 20), (20, 20)) for _ in range(50)]
    df = points(spark, rows)
    best = min((kmeans.fit(df, ["x", "y"], 4, seed=s) for s in (1, 2, 3)), key=lambda m: kmeans.wssse(df, m).first()[0])
    assert sorted((round(c[0] / 20), round(c[1] / 20)) for c in best.centres) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert kmeans.wssse(df, best).first()[0] < 200
    library, _ = kmeans.library_fit(df, ["x", "y"], 4)
    assert abs(library.summary.trainingCost - kmeans.wssse(df, best).first()[0]) < 1
    line = [x.wssse for x in kmeans.elbow(df, ["x", "y"], range(1, 3)).orderBy("k").collect()]
    assert line[0] >= line[1]


def test_kmeans_keeps_empty_clusters_and_checks_k(spark):
    df = points(spark, [(0, 0), (0, 0), (1, 1)])
    assert len(kmeans.fit(df, ["x", "y"], 3).centres) == 3
    with pytest.raises(ValueError):
        kmeans.fit(df, ["x", "y"], 4)


@pytest.mark.parametrize("in_task", [0, 1 << 20])
@FEW
@given(edges=st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=30))
def test_components(spark, monkeypatch, in_task, edges):
    monkeypatch.setattr("quernel.operators.components.IN_TASK", in_task)
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in label:
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label


@pytest.mark.parametrize("in_task", [0, 20, 1 << 20])
def test_long_path_is_one_component(spark, monkeypatch, in_task):
    monkeypatch.setattr("quernel.operators.components.IN_TASK", in_task)
    got = components(spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.agg(F.max("label"), F.count("*")).first()[:] == (0, 201)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from quernel.plans import lineage

    none = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_dir(SimpleNamespace(conf={}, sparkContext=context))
    table = lineage.stored(spark.range(3), "t")
    assert table.count() == 3 and lineage.shared_dir(spark) in table.inputFiles()[0]
    lineage.remove(spark, table.inputFiles()[0].rpartition("/")[0])


def test_running_sum(spark):
    got = running_sum(spark.range(1000), "id", "id", "before").where("before != id * (id - 1) / 2").count()
    assert got == 0


def test_summaries(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0)], "g int, v double")
    got = {r.g: (r.n, r.mean, r.std, r.p50) for r in summary.grouped_describe(df, "g", ["v"]).collect()}
    assert got == {1: (2, 2.0, 1.41, 2.0), 2: (1, 5.0, None, 5.0)}
    assert {r.g: r.v for r in summary.relative_importance(df, "g", ["v"]).collect()} == {1: round(2 / 3 - 1, 6), 2: round(5 / 3 - 1, 6)}


def test_calendar_fills_empty_days(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 5), 1.0), (datetime(2024, 1, 3, 1), 2.0)], "t timestamp, v double")
    assert [r.s for r in eda.resample(df, "t", "DAY", s=F.sum("v")).orderBy("bin").collect()] == [1.0, 0.0, 2.0]


def test_zone_is_split(spark):
    r = eda.split_zone(spark.createDataFrame([("2019-10-01 00:00:00 UTC",)], "t string"), "t").first()
    assert (r.local_time, r.zone) == ("2019-10-01 00:00:00", "UTC")


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "p.csv").write_text("a,b\n1,2\na,b\n3,x\n5,6\n")
    assert sorted((r.a, r.b) for r in files.read_points(spark, str(tmp_path / "p.csv")).collect()) == [(1.0, 2.0), (5.0, 6.0)]
    (tmp_path / "t.txt").write_text(" 1 2\n\n3   4\n")
    assert [tuple(r) for r in files.read_text_columns(spark, str(tmp_path / "t.txt")).collect()] == [("1", "2"), ("3", "4")]
    files.text_to_csv(spark, str(tmp_path / "t.txt"), str(tmp_path / "csv"))
    (tmp_path / "l.csv").write_bytes("n\ncafé\n".encode("latin-1"))
    assert files.read_csv(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").first().n == "café"
    found, centres = files.blobs(spark, 100, 3, 2)
    assert found.count() == 100 and centres.count() == 2
    with pytest.raises(ValueError):
        files.blobs(spark, features=1)
    labelled = spark.createDataFrame([(1.0, 2.0, 1)], "x double, y double, cluster int")
    sinks.write_clusters(labelled, str(tmp_path / "c"), ["x", "y"], single=True)
    assert files.read_csv(spark, str(tmp_path / "c")).columns == ["x", "y", "Cluster"]
    with pytest.raises(ValueError):
        sinks.write_clusters(labelled, str(tmp_path / "c"), ["z"])
    assert plotdata.pairs(labelled, ["x", "y"]).count() == 1 and plotdata.bars(labelled, "x", 3).count() == 1


def test_union_and_preclean(spark, tmp_path):
    events = spark.createDataFrame([(datetime(2024, 1, 1), "purchase", 1.0, "p"), (datetime(2024, 2, 1), "view", 1.0, "p")], "event_time timestamp, event_type string, price double, props string")
    assert files.union_parts([events, events]).count() == 4
    files.preclean(events, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).select("month").first()[0] == "2024-Jan"
    with pytest.raises(ValueError):
        files.union_parts([])


def test_streams(spark, tmp_path):
    from quernel.streaming.resample import user_sessions, windowed_sales

    schema = "event_time timestamp, event_type string, price double, user_id long"
    spark.createDataFrame([(datetime(2024, 1, 1, 1), "purchase", 2.0, 1), (datetime(2024, 1, 1, 1, 10), "purchase", 3.0, 2), (datetime(2024, 1, 2), "view", 1.0, 1)], schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, frame in (("sales", windowed_sales(stream)), ("sessions", user_sessions(stream))):
        frame.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination()
    assert [tuple(r) for r in spark.table("sales").select("sales", "n", "users").collect()] == [(5.0, 2, 2)]
    assert spark.table("sessions").count() == 3


def test_command_line(spark, tmp_path, capsys):
    from quernel import cli

    (tmp_path / "p.csv").write_text("x,y\n" + "".join(f"{i % 2 * 10 + i / 100},{i % 2 * 10}\n" for i in range(40)))
    cli.main(["--alg-name", "dbscan", "--file", str(tmp_path / "p.csv"), "--epsilon", "1", "--minPts", "3", "--out", str(tmp_path / "o"), "--make-plot", "true"])
    assert files.read_csv(spark, str(tmp_path / "o/clusters")).select("Cluster").distinct().count() == 2
    cli.main(["--alg-name", "kmeans-naive", "--file", str(tmp_path / "p.csv"), "--numK", "2"])
    cli.main(["nn-hist", "--file", str(tmp_path / "p.csv"), "--numBuckets", "4"])
    cli.main(["time", "--file", str(tmp_path / "p.csv"), "--repeats", "1", "--epsilon", "1", "--out", str(tmp_path / "t")])
    assert len(spark.read.text(str(tmp_path / "t/timing")).collect()) == 9
    cli.main(["dbscan", "--file", str(tmp_path / "p.csv"), "--epsilon", "1", "--debugOutput", str(tmp_path / "d")])
    assert spark.read.parquet(str(tmp_path / "d/pairs")).count() > 0
    assert "cluster" in capsys.readouterr().out


def test_results_go_to_any_store(spark, tmp_path, capsys):
    """A store that only Spark's file systems reach; datasets by a file of paths; pictures."""
    from xml.etree import ElementTree

    from quernel import cli

    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.any.link./out", f"file://{tmp_path}")
    out = "viewfs://any/out"
    sinks.write_csv(spark.createDataFrame([(1, "a")], "x int, y string"), f"{out}/csv", single=True)
    sinks.write_lines(spark.range(3), f"{out}/lines", "id")
    assert files.read_csv(spark, f"{out}/csv", "x int, y string").first()[:] == (1, "a") and spark.read.text(f"{out}/lines").count() == 3
    (tmp_path / "paths.json").write_text('{"onlineretail": "/root/testdata/sf0.001"}')
    cli.main(["nn-hist", "--dataset", "onlineretail", "--paths", f"{out}/paths.json", "--numBuckets", "4", "--out", f"{out}/result", "--make-plot", "true"])
    picture = ElementTree.fromstring("".join(r[0] for r in spark.read.text(f"{out}/result/plots/histogram").collect()))
    assert len(picture.findall("{http://www.w3.org/2000/svg}rect")) == 5
    with pytest.raises(SystemExit):
        cli.main(["nn-hist", "--dataset", "instacart", "--paths", f"{out}/paths.json"])
    capsys.readouterr()


def test_pictures():
    from types import SimpleNamespace
    from xml.etree import ElementTree

    from quernel.operators import svg

    frame = lambda rows: SimpleNamespace(collect=lambda: rows)
    for picture in (svg.bar_chart(frame([])), svg.bar_chart(frame([{"label": "<1 & 2", "height": 3}])), svg.line_chart(frame([{"x": 2, "y": 5}, {"x": 3, "y": 5}])), svg.line_chart(frame([]))):
        assert ElementTree.fromstring(picture).tag.endswith("svg")
