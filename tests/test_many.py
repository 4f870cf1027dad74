"""Many runs in one job against each run by itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventweave.operators import many, online as on
from eventweave.plans import queries

from test_operators import groups_loops, reference_step

RUNS, NODES, STEPS = 20, 7, 2
SF = "/root/testdata/sf0.001"


def made(spark, known):
    """Counts, nodes and edges of RUNS random networks; each run's matrices by step, and its graph."""
    rng = np.random.default_rng(5)
    matrices, graphs, counts, edges = {}, {}, [], []
    for run in range(RUNS):
        graphs[run] = a = (rng.random((NODES, NODES)) < 0.6).astype(int) if known else np.ones((NODES, NODES), int)
        matrices[run] = [rng.poisson(1 + 2 * rng.random((NODES, NODES))) * a for _ in range(STEPS)]
        counts += [(run, s, int(i), int(j), int(m[i, j])) for s, m in enumerate(matrices[run]) for i, j in zip(*np.nonzero(m), strict=True)]
        edges += [(run, int(i), int(j)) for i, j in zip(*np.nonzero(a), strict=True)]
    counts = spark.createDataFrame(counts, "run int, step int, src int, dst int, n long")
    nodes = spark.createDataFrame([(r, i) for r in range(RUNS) for i in range(NODES)], "run int, node int")
    return counts, nodes, spark.createDataFrame(edges, "run int, src int, dst int") if known else None, matrices, graphs


def shares(rows, k):
    return np.array([[r[f"p{i}"] for i in range(k)] for r in rows])


@pytest.mark.parametrize("mode", ["known", "complete", "groups", "sticks"])
def test_runs_at_once_are_the_runs_alone(spark, mode):
    counts, nodes, edges, matrices, graphs = made(spark, mode == "known")
    o = on.Options(k=3 if mode in ("groups", "sticks") else 2, delta=0.5, mode="groups" if mode in ("groups", "sticks") else "known", forget_rate=0.4, forget_pi=0.8, forget_u=0.9, forget_z=0.7 if mode in ("groups", "sticks") else 1.0, gamma=(1.0, 2.0), nu=1.5, n_cavi=2, n_sweeps=2 if mode in ("known", "groups") else 1, literal_sticks=mode == "sticks")
    tau, rates = many.run_many(counts, nodes, o, STEPS, edges)
    found = tau.where(F.col("step") == STEPS).orderBy("run", "node").collect()
    begun = tau.where("step = 0").orderBy("run", "node").collect()
    post = {(r.run, r.k, r.m): (r.alpha, r.beta) for r in rates.where(F.col("step") == STEPS).collect()}
    assert len(found) == RUNS * NODES and len(post) == RUNS * o.k**2
    state = on.start(nodes.where("run = 0").select("node"), o)
    for run in range(RUNS if mode != "sticks" else 0):  # the loops have the exclusive sum alone
        tau0, p = shares([r for r in begun if r.run == run], o.k), {x: y.copy() for x, y in state.params.items()}
        if o.mode == "groups":
            alone, p = groups_loops(o, tau0, p, matrices[run])
        else:
            alone = tau0
            for m in matrices[run]:
                alone = reference_step(graphs[run], m, alone, p, o)
        assert shares([r for r in found if r.run == run], o.k) == pytest.approx(alone, abs=1e-9)
        for (i, j), a in np.ndenumerate(p["alpha"]):
            assert post[run, i, j] == pytest.approx((a, p["beta"][i, j]))
    # One run by the operator for one.
    one, log, _ = on.run_online(counts.where("run = 3").drop("run"), nodes.where("run = 3").select("node"), o, STEPS, edges.where("run = 3").drop("run") if edges is not None else None)
    mine = tau.where("run = 3").orderBy("step", "node").collect()
    assert shares(mine, o.k) == pytest.approx(shares(one.orderBy("step", "node").collect(), o.k), abs=1e-9)
    assert [tuple(r) for r in rates.where("run = 3").orderBy("step", "k", "m").select("step", "k", "m").collect()] == [tuple(r) for r in log.orderBy("step", "k", "m").select("step", "k", "m").collect()]
    assert np.array([[r.alpha, r.beta] for r in rates.where("run = 3").orderBy("step", "k", "m").collect()]) == pytest.approx(np.array([[r.alpha, r.beta] for r in log.orderBy("step", "k", "m").collect()]))


def test_jobs_do_not_grow_with_the_runs(spark):
    counts, nodes, _, _, _ = made(spark, False)
    o = on.Options(k=2, delta=0.5, n_cavi=1, n_sweeps=2)
    jobs, sc = {}, spark.sparkContext
    for runs in (2, RUNS):
        sc.setJobGroup(f"many-{runs}", "")
        many.run_many(counts.where(F.col("run") < runs), nodes.where(F.col("run") < runs), o, STEPS)
        jobs[runs] = len(sc.statusTracker().getJobIdsForGroup(f"many-{runs}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[RUNS] < 1.25 * jobs[2]  # ten times the runs; AQE takes a few more or less as tables grow


def test_odd_runs(spark):
    """A run without counts keeps its nodes; a null run takes no part; no runs at all give empty tables; modes that aren't for it are refused."""
    counts = spark.createDataFrame([(1, 0, 0, 1, 4), (None, 0, 0, 1, 9)], "run int, step int, src int, dst int, n long")
    nodes = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 1), (None, 0)], "run int, node int")
    tau, rates = many.run_many(counts, nodes, on.Options(k=2, delta=1.0), 1)
    assert {(r.run, r.node) for r in tau.where("step = 1").collect()} == {(1, 0), (1, 1), (2, 0), (2, 1)}
    assert rates.where("step = 1 and run = 2").agg(F.sum("alpha")).first()[0] == pytest.approx(4.0)  # priors of 1 alone
    none, log = many.run_many(counts.limit(0), nodes.limit(0), on.Options(k=2, delta=1.0), 1)
    assert none.isEmpty() and log.isEmpty()
    for o in (on.Options(k=2, delta=1.0, mode="graph"), on.Options(k=2, delta=1.0, begin="spectral"), on.Options(k=2, delta=1.0, tolerance=0.1)):
        with pytest.raises(ValueError):
            many.run_many(counts, nodes, o, 1)


def test_registered_runs_are_the_runs_alone(spark):
    """The registered query's own runs over all trades of sf0.001, in three intervals of 900 days."""
    counts, rates = queries.runs_online(spark, SF, 900.0)
    _, alone, _ = on.run_online(counts.where("run = 2").drop("run"), queries._groups(spark, SF).select("node"), on.Options(k=3, delta=900.0, forget_rate=0.1, n_cavi=2, n_sweeps=3), queries._steps(spark, SF, 900.0))
    mine, theirs = (np.array([[r.alpha, r.beta] for r in t.orderBy("step", "k", "m").collect()]) for t in (rates.where("run = 2"), alone))
    assert len(mine) == 4 * 9 and mine == pytest.approx(theirs, rel=1e-6)
    assert {r[0] for r in rates.select("run").distinct().collect()} == set(range(queries.RUNS))
