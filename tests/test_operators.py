"""Operators against plain loops."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventweave.functions.special import digamma_of
from eventweave.operators import changepoint as cp
from eventweave.operators import counts as ct
from eventweave.operators import evaluate as ev
from eventweave.operators import online as on
from eventweave.operators import posterior as po
from eventweave.operators import relabel as rl
from eventweave.sources import networks as nw


def test_counts(spark):
    events = spark.createDataFrame([(0, 1, 0.0), (0, 1, 0.99), (0, 1, 1.0), (1, 1, 2.5)], "src int, dst int, t double")
    counts = ct.interval_counts(events, 1.0)
    assert sorted((r.step, r.src, r.dst, r.n) for r in counts.collect()) == [(0, 0, 1, 2), (1, 0, 1, 1), (2, 1, 1, 1)]
    assert sorted((r.step, r.full) for r in ct.cumulative_counts(counts).collect()) == [(0, 2), (1, 3), (2, 1)]
    assert sorted((r.src, r.first_step) for r in ct.first_seen(counts).collect()) == [(0, 0), (1, 2)]
    assert sorted(r.times for r in ct.arrival_lists(events, 1.0).collect()) == [[0.0, 0.99], [1.0], [2.5]]


def test_dense_labels(spark):
    rows = [(f"k{random.Random(i).randrange(200)}", i) for i in range(1000)]
    out = {r.key: r.node for r in rl.dense_labels(spark.createDataFrame(rows, "key string, at int"), "key", ["at"]).collect()}
    expected = {}
    for k, _ in rows:
        expected.setdefault(k, len(expected))
    assert out == expected


def test_trip_network(spark, tmp_path):
    (tmp_path / "trips").mkdir()
    for i, body in enumerate(("1,A ,x,02/01/2019 00:10,02/01/2019 00:00\n2,A ,nowhere,02/01/2019 00:10,02/01/2019 00:00\n", "3,x,B_OLD,09/01/2019 00:20,09/01/2019 00:05\n4,twin,A ,10/01/2019 00:20,10/01/2019 00:05\n")):
        (tmp_path / f"trips/{i}.csv").write_text("Id,StartStation Name,EndStation Name,End Date,Start Date\n" + body)
    (tmp_path / "s.csv").write_text('StationName,latitude,longitude\n"A ",1.0,1.0\nx,2.0,1.0\nB,3.0,1.0\ntwin,2.0,1.0\n')
    trips, stations = nw.read_trips(spark, str(tmp_path / "trips")), nw.read_stations(spark, str(tmp_path / "s.csv"))
    events, nodes = rl.trip_network(trips, stations, "2019-01-02")
    number = {r.place: r.node for r in nodes.collect()}
    assert number["A "] == 0 and set(number) == {"A ", "twin", "B"}  # twin stands for x, which shares its place
    assert sorted((r.src, r.dst, r.t) for r in events.collect()) == sorted([(number["A "], number["twin"], 0.5), (number["twin"], number["B"], 1.5), (number["twin"], number["A "], 1.5)])
    for _ in range(2):  # the second takes the place of the first
        nw.write_network(events, nodes, str(tmp_path / "network"))
    again = nw.read_network(spark, str(tmp_path / "network"))
    assert [sorted(map(str, t.collect())) for t in again] == [sorted(map(str, t.collect())) for t in (events, nodes)]
    nw.write_run(events, str(tmp_path / "out"), "trips", 1, 0)
    assert spark.read.parquet(str(tmp_path / "out")).where("study = 'trips' and idx = 1").count() == 3


def network(n, k, seed, density=0.6):
    rng = np.random.default_rng(seed)
    a = (rng.random((n, n)) < density).astype(float)
    counts = rng.poisson(2.0, (n, n)) * a
    tau = rng.random((n, k)) + 0.1
    return rng, a, counts, tau / tau.sum(axis=1, keepdims=True)


def frame(spark, tau):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(tau)], "node int, " + ", ".join(f"p{i} double" for i in range(tau.shape[1])))


def edges_of(spark, a, counts):
    return spark.createDataFrame([(int(i), int(j), int(counts[i, j]), float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "src int, dst int, n long, w double")


def loop_scores(a, counts, tau, weight, log_rate, rate, delta, self_weight):
    n, k = tau.shape
    out = np.zeros((n, k))
    for i, g in product(range(n), range(k)):
        out[i, g] = weight[g] + a[i, i] * counts[i, i] * log_rate[g][g] - (a[i, i] if self_weight else 1) * delta * rate[g][g]
        for m, j in product(range(k), range(n)):
            if j != i or m != g:
                out[i, g] += tau[j, m] * (a[i, j] * (counts[i, j] * log_rate[g][m] - delta * rate[g][m]) + a[j, i] * (counts[j, i] * log_rate[m][g] - delta * rate[m][g]))
    return out


@pytest.mark.parametrize("self_weight", [True, False])
def test_membership_scores(spark, self_weight):
    rng, a, counts, tau = network(9, 3, 1)
    weight, log_rate, rate = rng.random(3).tolist(), rng.normal(size=(3, 3)).tolist(), rng.random((3, 3)).tolist()
    sums = po.neighbour_sums(edges_of(spark, a, counts), frame(spark, tau), 3)
    rows = po.membership_scores(frame(spark, tau), sums, weight, log_rate, rate, 0.7, self_weight)
    got = np.array([[r.q0, r.q1, r.q2] for r in rows.orderBy("node").collect()])
    assert got == pytest.approx(loop_scores(a, counts, tau, weight, log_rate, rate, 0.7, self_weight))
    soft = np.array([[r.p0, r.p1, r.p2] for r in po.softmax(rows, 3, ["node"]).orderBy("node").collect()])
    e = np.exp(got - got.max(axis=1, keepdims=True))
    assert soft == pytest.approx(e / e.sum(axis=1, keepdims=True))


def test_best_group_takes_the_lowest_of_equals(spark):
    rows = frame(spark, np.array([[0.4, 0.4, 0.2], [0.2, 0.4, 0.4], [0.1, 0.2, 0.7]]))
    assert [r.g for r in rows.select(po.best_group(3).alias("g"), "node").orderBy("node").collect()] == [0, 1, 2]


def reference_step(a, counts, tau, p, o):
    """One interval of the known-graph mode in plain numpy, all nodes at once."""
    psi, k = np.vectorize(digamma_of), o.k
    prior = {x: y.copy() for x, y in p.items()}
    for _ in range(o.n_cavi):
        for _ in range(o.n_sweeps):
            s = loop_scores(a, counts, tau, psi(p["gamma"]) - digamma_of(p["gamma"].sum()), (psi(p["alpha"]) - np.log(p["beta"])).tolist(), (p["alpha"] / p["beta"]).tolist(), o.delta, False)
            e = np.exp(s - s.max(axis=1, keepdims=True))
            tau = e / e.sum(axis=1, keepdims=True)
        p["gamma"] = o.forget_pi * (prior["gamma"] - 1) + tau.sum(axis=0) + 1
        p["alpha"] = p["guard"] * (prior["alpha"] - 1) + tau.T @ (a * counts) @ tau + 1
        p["beta"] = p["guard"] * prior["beta"] + o.delta * tau.T @ a @ tau
        p["guard"] = np.where(tau.T @ a @ tau < 0.1, 1.0, o.forget_rate)
    return tau


@pytest.mark.parametrize("complete", [True, False])
def test_online_step_against_loops(spark, complete):
    _, a, counts, _ = network(8, 2, 3)
    a = np.ones_like(a) if complete else a
    counts = counts * a
    nodes = spark.range(8).select(F.col("id").cast("int").alias("node"))
    o = on.Options(k=2, delta=0.5, forget_rate=0.3, n_cavi=2, n_sweeps=2)
    edges = edges_of(spark, a, counts)
    state = on.start(nodes, o, None if complete else edges.select("src", "dst"))
    tau = np.array([[r.p0, r.p1] for r in state.tau.orderBy("node").collect()])
    p = {x: y.copy() for x, y in state.params.items()}
    state = on.advance(state, edges.where("n > 0").select("src", "dst", "n"))
    tau = reference_step(a, counts, tau, p, o)
    assert np.array([[r.p0, r.p1] for r in state.tau.orderBy("node").collect()]) == pytest.approx(tau)
    for x in ("alpha", "beta", "gamma", "guard"):
        assert state.params[x] == pytest.approx(p[x])


def test_online_graph_sums(spark):
    """Sums over kinds of nodes equal those over the whole matrix of edge probabilities."""
    _, _, counts, tau = network(8, 2, 5, 0.3)
    nodes = spark.range(8).select(F.col("id").cast("int").alias("node"))
    o = on.Options(k=2, delta=0.2, mode="graph", k_prime=2, n_cavi=1, n_sweeps=1, forget_rate=0.5)
    state = on.start(nodes, o)
    rows = spark.createDataFrame([(int(i), int(j), int(counts[i, j])) for i, j in zip(*np.nonzero(counts), strict=True)], "src int, dst int, n long")
    for _ in range(2):
        state = on.advance(state, rows)
    sigma = np.zeros((8, 8))
    for r in on.edge_probabilities(state).collect():
        sigma[r.src, r.dst] = r.sigma
    assert (sigma[counts > 0] == 1).all() and (sigma[counts == 0] < 1).all() and (sigma > 0).all()
    on._graph_tables(state, rows)
    got = on._joined(state, frame(spark, tau), rows, 2).orderBy("node").collect()
    for m in range(2):
        assert [r[f"to{m}"] for r in got] == pytest.approx(sigma @ tau[:, m])
        assert [r[f"ti{m}"] for r in got] == pytest.approx(sigma.T @ tau[:, m])
        assert [r[f"so{m}"] for r in got] == pytest.approx((sigma * counts) @ tau[:, m])
    assert [r.own_w for r in got] == pytest.approx(np.diag(sigma))
    assert [r.own_n for r in got] == pytest.approx(np.diag(sigma * counts))


def sampled(spark, rates, seed=3, nodes=40, first=24, end=2.0):
    """Events of a network of two groups with those rates, and the nodes' groups."""
    rng = np.random.default_rng(seed)
    grp = [int(i >= first) for i in range(nodes)]
    rows = [(i, j, float(t)) for i, j in product(range(nodes), repeat=2) for t in rng.random(rng.poisson(rates[grp[i]][grp[j]] * end)) * end]
    return spark.createDataFrame(rows, "src int, dst int, t double"), spark.createDataFrame(list(enumerate(grp)), "node int, truth int")


def recovered(spark, rates, mode="known", k=2):
    events, labels = sampled(spark, rates)
    counts = ct.interval_counts(events, 0.5)
    tau, post, _ = on.run_online(counts, labels.select("node"), on.Options(k=k, delta=0.5, mode=mode, forget_rate=0.5, n_cavi=2, n_sweeps=2), 3)
    rows = tau.select("step", "node", po.best_group(k).alias("found")).join(labels, "node")
    sums = tau.select("step", sum((F.col(f"p{i}") for i in range(1, k)), F.col("p0")).alias("s")).agg(F.max(F.abs(F.col("s") - 1))).first()[0]
    assert sums < 1e-9 and post.where("alpha <= 0 or beta <= 0").isEmpty()
    return {r.step: r.ari for r in ev.adjusted_rand(rows, ["step"]).collect()}[3]


def test_online_recovers_groups(spark):
    strong = [[3.0, 0.8], [0.5, 6.0]]
    assert recovered(spark, strong) > 0.95
    assert abs(recovered(spark, [[2.0, 2.0], [2.0, 2.0]])) < 0.4  # no structure to find
    assert recovered(spark, [[2.5, 1.2], [0.4, 7.5]], "groups", 4) > 0.5


STRONG, WEAK = [[3.0, 0.8], [0.5, 6.0]], [[1.5, 1.0], [1.0, 2.5]]


@pytest.mark.parametrize("mode", ["known", "groups"])
@pytest.mark.parametrize("sweeps", [2, 3])
def test_spectral_start_finds_groups(spark, mode, sweeps):
    """Rates close together, few sweeps: a lean start in the groups mode ends with all nodes in one group here."""
    rng, truth = np.random.default_rng(3), np.repeat([0, 1], [24, 16])
    nodes = spark.range(40).select(F.col("id").cast("int").alias("node"))
    for rates in (STRONG, WEAK) if sweeps == 2 else (WEAK,):
        counts = rng.poisson(np.array(rates)[truth][:, truth], (1, 40, 40))
        rows = spark.createDataFrame([(int(s), int(i), int(j), int(counts[s, i, j])) for s, i, j in zip(*np.nonzero(counts), strict=True)], "step int, src int, dst int, n long")
        tau, _, state = on.run_online(rows, nodes, on.Options(k=2, delta=1.0, mode=mode, forget_rate=0.1, n_cavi=2, n_sweeps=sweeps, begin="spectral"), 1)
        found = tau.where("step = 1").orderBy("node").select(po.best_group(2).alias("found")).collect()
        labels = spark.createDataFrame([(int(t), r.found) for t, r in zip(truth, found, strict=True)], "truth int, found int").withColumn("all", F.lit(1))
        assert ev.adjusted_rand(labels, ["all"]).first().ari >= 0.9
        assert state.energies[1] >= state.energies[0] - 1e-6


def test_event_space_is_the_matrix_s(spark):
    """The main directions of A A' + A' A and their lengths, against numpy; silent nodes aren't in it."""
    from eventweave.operators.starts import event_space, spectral_shares

    rng, truth = np.random.default_rng(5), np.repeat([0, 1, 2], [12, 8, 6])
    a = rng.poisson(np.array([[9, 2, 1], [1, 12, 3], [4, 1, 20]])[truth][:, truth]).astype(float)
    counts = edges_of(spark, np.ones_like(a), a).where("n > 0")
    nodes = spark.range(28).select(F.col("id").cast("int").alias("node"))
    rows = event_space(po.both_ways(counts.withColumn("w", F.lit(1.0))), nodes, 3, rounds=25).orderBy("node").collect()
    x = np.array([r[1:] for r in rows])
    assert [r.node for r in rows] == list(range(26))
    size, way = np.linalg.eigh(a @ a.T + a.T @ a)
    expected = way[:, ::-1][:, :3] * np.sqrt(size[::-1][:3])
    assert x @ x.T == pytest.approx(expected @ expected.T, rel=1e-6)
    tau = spectral_shares(counts, nodes, 3).orderBy("node").collect()
    assert [max(range(3), key=lambda i: r[f"p{i}"]) for r in tau[:26]] == truth.tolist()  # largest group first
    assert all(tuple(r)[1:] == pytest.approx((1 / 3,) * 3) for r in tau[26:])
    empty = spectral_shares(counts.limit(0), nodes, 2).collect()
    assert len(empty) == 28 and all(r.p0 == 0.5 for r in empty)


@pytest.mark.parametrize("mode", ["known", "groups"])
def test_energy_is_the_plain_sum(spark, mode):
    psi, lg, (n, k, delta) = np.vectorize(digamma_of), np.vectorize(math.lgamma), (7, 3, 0.5)
    _, a, counts, _ = network(n, k, 17)
    nodes = spark.range(n).select(F.col("id").cast("int").alias("node"))
    o = on.Options(k=k, delta=delta, mode=mode, forget_rate=0.4, forget_pi=0.7, forget_u=0.6, gamma=1.5, nu=1.3, alpha=2.0, n_cavi=1, n_sweeps=2, begin="spectral")
    state = on.start(nodes, o, None if mode == "groups" else edges_of(spark, a, counts).select("src", "dst"))
    a = np.ones_like(a) if mode == "groups" else a
    for _ in range(2):
        prior, guard = {x: y.copy() for x, y in state.params.items()}, state.params["guard"]
        state = on.advance(state, edges_of(spark, a, counts).where("n > 0").select("src", "dst", "n"))
        p, tau, value = state.params, shares(state.tau, k), 0.0
        if mode == "groups":
            both = psi(p["omega"] + p["nu"])
            weight = np.array([psi(p["omega"][g]) - both[g] + sum(psi(p["nu"][h]) - both[h] for h in range(g)) for g in range(k)])
        else:
            weight = psi(p["gamma"]) - digamma_of(float(p["gamma"].sum()))
        for i, g in product(range(n), range(k)):
            value += tau[i, g] * (weight[g] - math.log(tau[i, g]))
            for j, m in product(range(n), range(k)):
                value += a[i, j] * tau[i, g] * tau[j, m] * (counts[i, j] * (psi(p["alpha"][g, m]) - math.log(p["beta"][g, m])) - delta * p["alpha"][g, m] / p["beta"][g, m])
        for g, m in product(range(k), repeat=2):
            x, y, c, d = p["alpha"][g, m], p["beta"][g, m], guard[g, m] * (prior["alpha"][g, m] - 1) + 1, guard[g, m] * prior["beta"][g, m]
            # Divergence as the expected difference of the log densities.
            value -= x * math.log(y) - math.lgamma(x) - c * math.log(d) + math.lgamma(c) + (x - c) * (digamma_of(x) - math.log(y)) - (y - d) * x / y
        if mode == "groups":
            for g in range(k):
                w, v, w0, v0 = p["omega"][g], p["nu"][g], o.forget_u * (prior["omega"][g] - 1) + 1, o.forget_u * (prior["nu"][g] - 1) + 1
                log_b = lambda u, t: math.lgamma(u) + math.lgamma(t) - math.lgamma(u + t)
                value -= log_b(w0, v0) - log_b(w, v) + (w - w0) * (digamma_of(w) - digamma_of(w + v)) + (v - v0) * (digamma_of(v) - digamma_of(w + v))
        else:
            g1, g0 = p["gamma"], o.forget_pi * (prior["gamma"] - 1) + 1
            value -= math.lgamma(g1.sum()) - lg(g1).sum() - math.lgamma(g0.sum()) + lg(g0).sum() + ((g1 - g0) * (psi(g1) - digamma_of(float(g1.sum())))).sum()
        assert state.energies == [pytest.approx(value)]


@pytest.mark.parametrize("complete", [True, False])
def test_sweeps_of_the_front(spark, complete):
    """With tolerance 0 the numbers are those of full sweeps; with more, they are near, and fewer edges are read."""
    rng, truth = np.random.default_rng(13), np.repeat([0, 1], [16, 14])
    counts = rng.poisson(np.array([[5.0, 0.4], [0.3, 7.0]])[truth][:, truth], (2, 30, 30))
    rows = spark.createDataFrame([(int(s), int(i), int(j), int(counts[s, i, j])) for s, i, j in zip(*np.nonzero(counts), strict=True)], "step int, src int, dst int, n long")
    nodes = spark.range(30).select(F.col("id").cast("int").alias("node"))
    edges = None if complete else spark.createDataFrame([(i, j) for i in range(30) for j in range(30) if counts[:, i, j].sum() or (i + j) % 3 == 0], "src int, dst int")
    run = lambda tolerance: on.run_online(rows, nodes, on.Options(k=2, delta=1.0, mode="groups" if complete else "known", forget_rate=0.3, n_cavi=2, n_sweeps=2, begin="spectral", tolerance=tolerance), 2, edges)
    (tau, _, full), (exact, _, zero), (close, _, some) = run(None), run(0.0), run(1e-3)
    of = lambda t: shares(t.where("step = 2"), 2)
    assert of(exact) == pytest.approx(of(tau), abs=1e-9) and of(close) == pytest.approx(of(tau), abs=0.02)
    for x in ("alpha", "beta"):
        assert zero.params[x] == pytest.approx(full.params[x]) and some.params[x] == pytest.approx(full.params[x], rel=0.02)
    assert some.energies == pytest.approx(full.energies, rel=1e-2)
    assert len(some.edges_read) == 5 and sum(some.edges_read[1:]) < sum(zero.edges_read[1:]) and sum(some.edges_read[1:]) < 2 * some.edges_read[0]


def shares(table, k):
    return np.array([[r[f"p{i}"] for i in range(k)] for r in table.orderBy("node").collect()])


def softmax_rows(s):
    e = np.exp(s - s.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def groups_loops(o, tau, p, matrices):
    """Intervals of the groups mode in plain numpy: stick-breaking weights, their update, rates."""
    psi, k, full = np.vectorize(digamma_of), o.k, np.ones_like(matrices[0])
    for counts in matrices:
        prior = {x: y.copy() for x, y in p.items()}
        for _ in range(o.n_cavi):
            for _ in range(o.n_sweeps):
                weight = [o.forget_z * (psi(p["omega"][g]) - psi(p["omega"][g] + p["nu"][g]) + sum(psi(p["nu"][h]) - psi(p["omega"][h] + p["nu"][h]) for h in range(g))) for g in range(k)]
                tau = softmax_rows(loop_scores(full, counts, tau, weight, (psi(p["alpha"]) - np.log(p["beta"])).tolist(), (p["alpha"] / p["beta"]).tolist(), o.delta, False))
            mass = tau.sum(axis=0)
            p["omega"] = o.forget_u * (prior["omega"] - 1) + o.forget_z * mass + 1
            p["nu"] = np.array([o.forget_z * mass[g + 1 :].sum() + o.forget_u * (prior["nu"][g] - 1) + 1 for g in range(k)])
            p["alpha"] = p["guard"] * (prior["alpha"] - 1) + tau.T @ counts @ tau + 1
            p["beta"] = p["guard"] * prior["beta"] + o.delta * np.outer(mass, mass)
            p["guard"] = np.where(np.outer(mass, mass) < 0.1, 1.0, o.forget_rate)
    return tau, p


def graph_loops(o, tau, prime, p, matrices):
    """Intervals of the graph mode over the whole matrix of edge probabilities, which the operator never builds."""
    psi, k, n = np.vectorize(digamma_of), o.k, len(tau)
    sigma, big, seen = np.full((n, n), o.sigma), np.zeros((n, n)), np.zeros((n, n), bool)
    for counts in matrices:
        prior = {x: y.copy() for x, y in p.items()}
        for _ in range(o.n_cavi):
            for _ in range(o.n_sweeps):
                weight = psi(p["gamma"]) - digamma_of(p["gamma"].sum())
                tau = softmax_rows(loop_scores(sigma, counts, tau, weight, (psi(p["alpha"]) - np.log(p["beta"])).tolist(), (p["alpha"] / p["beta"]).tolist(), o.delta, True))
            there, gone = (psi(p[x]) - psi(p["eta"] + p["zeta"]) for x in ("eta", "zeta"))
            for _ in range(o.n_sweeps):
                s = np.zeros((n, o.k_prime))
                for i, g in product(range(n), range(o.k_prime)):
                    s[i, g] = psi(p["xi"][g]) - digamma_of(p["xi"].sum()) + sigma[i, i] * there[g, g] + (1 - sigma[i, i]) * gone[g, g]
                    for j, m in product(range(n), range(o.k_prime)):
                        if j != i or m != g:
                            s[i, g] += prime[j, m] * (sigma[i, j] * there[g, m] + (1 - sigma[i, j]) * gone[g, m] + sigma[j, i] * there[m, g] + (1 - sigma[j, i]) * gone[m, g])
                prime = softmax_rows(s)
            pairs = tau.T @ sigma @ tau
            p["gamma"] = o.forget_pi * (prior["gamma"] - 1) + tau.sum(axis=0) + 1
            p["alpha"] = p["guard"] * (prior["alpha"] - 1) + tau.T @ (sigma * counts) @ tau + 1
            p["beta"] = p["guard"] * prior["beta"] + o.delta * pairs
            p["guard"] = np.where(pairs < 0.1, 1.0, o.forget_rate)
            p["xi"] = prior["xi"] + prime.sum(axis=0)
            p["eta"] = o.forget_rho * (prior["eta"] - 1) + prime.T @ sigma @ prime + 1
            p["zeta"] = o.forget_rho * (prior["zeta"] - 1) + prime.T @ (1 - sigma) @ prime + 1
            z, g = tau.argmax(axis=1), prime.argmax(axis=1)
            big = big + (p["alpha"] / p["beta"])[z][:, z]
            rho = (p["eta"] / (p["eta"] + p["zeta"]))[g][:, g]
            seen |= counts > 0
            sigma = np.where(seen, 1.0, rho * np.exp(-o.delta * big) / (1 - rho + rho * np.exp(-o.delta * big)))
    return tau, prime, p, sigma


def test_online_number_of_groups_against_loops(spark):
    n, k = 9, 3
    _, _, counts, _ = network(n, k, 11)
    o = on.Options(k=k, delta=0.5, mode="groups", forget_rate=0.4, forget_u=0.9, forget_z=0.8, nu=1.7, n_cavi=2, n_sweeps=3)
    state = on.start(spark.range(n).select(F.col("id").cast("int").alias("node")), o)
    rows = edges_of(spark, np.ones((n, n)), counts).where("n > 0").select("src", "dst", "n")
    tau, p = groups_loops(o, shares(state.tau, k), {x: y.copy() for x, y in state.params.items()}, [counts] * 2)
    for _ in range(2):
        state = on.advance(state, rows)
    assert shares(state.tau, k) == pytest.approx(tau)
    for x in ("alpha", "beta", "omega", "nu", "guard"):
        assert state.params[x] == pytest.approx(p[x]), x


def test_online_graph_against_loops(spark):
    n, k = 8, 2
    o = on.Options(k=k, delta=0.3, mode="graph", k_prime=2, forget_rate=0.5, forget_rho=0.9, sigma=0.4, n_cavi=2, n_sweeps=2)
    state = on.start(spark.range(n).select(F.col("id").cast("int").alias("node")), o)
    start, matrices = shares(state.tau, k), [network(n, k, seed, 0.3)[2] for seed in (5, 6)]
    state.tau_prime = on.staged(frame(spark, start[:, ::-1]))  # equal shares would stay equal
    tau, prime, p, sigma = graph_loops(o, start, start[:, ::-1], {x: y.copy() for x, y in state.params.items()}, matrices)
    for counts in matrices:
        state = on.advance(state, spark.createDataFrame([(int(i), int(j), int(counts[i, j])) for i, j in zip(*np.nonzero(counts), strict=True)], "src int, dst int, n long"))
    assert shares(state.tau, k) == pytest.approx(tau) and shares(state.tau_prime, k) == pytest.approx(prime)
    for x in ("alpha", "beta", "gamma", "xi", "eta", "zeta", "guard"):
        assert state.params[x] == pytest.approx(p[x]), x
    assert {(r.src, r.dst): r.sigma for r in on.edge_probabilities(state).collect()} == pytest.approx({(i, j): sigma[i, j] for i, j in product(range(n), repeat=2)})


def test_registered_online_queries_against_loops(spark):
    """The three online queries' own runs over all trades of sf0.001, in three intervals of 900 days, against plain loops."""
    from eventweave.plans import queries as qs

    sf, delta = "/root/testdata/sf0.001", 900.0
    events = nw.trade_events(spark, sf).collect()
    matrices = [np.zeros((25, 25)) for _ in range(qs._steps(spark, sf, delta))]
    for r in events:
        matrices[int(r.t // delta)][r.src, r.dst] += 1
    assert len(matrices) == 3
    for options in ({"k": 3}, {"k": 5, "mode": "groups"}, {"k": 2, "mode": "graph", "k_prime": 2}):
        tau, rates, state = qs._online(spark, sf, delta, **options)
        o, k = state.options, state.options.k
        begin = on.start(spark.range(25).select(F.col("id").cast("int").alias("node")), o)
        p = {x: y.copy() for x, y in begin.params.items()}
        if o.mode == "known":
            found = shares(begin.tau, k)
            for counts in matrices:
                found = reference_step(np.ones((25, 25)), counts, found, p, o)
        elif o.mode == "groups":
            found, p = groups_loops(o, shares(begin.tau, k), p, matrices)
        else:
            found, _, p, sigma = graph_loops(o, shares(begin.tau, k), np.full((25, 2), 0.5), p, matrices)
            assert {(r.src, r.dst): r.sigma for r in on.edge_probabilities(state).collect()} == pytest.approx({(i, j): sigma[i, j] for i, j in product(range(25), repeat=2)})
        assert shares(tau.where("step = 3"), k) == pytest.approx(found, abs=1e-6), o.mode
        last = {(r.k, r.m): (r.alpha, r.beta) for r in rates.where("step = 3").collect()}
        assert last == {(i, j): pytest.approx((p["alpha"][i, j], p["beta"][i, j])) for i, j in product(range(k), repeat=2)}


def test_option_checks():
    for bad in ({"mode": "both"}, {"k": 0}, {"alpha": 0.0}, {"mode": "graph", "sigma": 1.0}):
        with pytest.raises(ValueError):
            on.Options(**({"k": 2, "delta": 1.0} | bad))


def test_rate_change_is_found(spark):
    rng = np.random.default_rng(8)
    a, b, rows = 1.0, 1.0, [(0, 0, 0, 1.0, 1.0)]
    for step in range(1, 41):
        mean = 200 if step < 25 else 420
        a, b = 0.1 * (a - 1) + float(rng.poisson(mean)) + 1, 0.1 * b + 100
        rows.append((step, 0, 0, a, b))
    found = cp.rate_changes(spark.createDataFrame(rows, "step int, k int, m int, alpha double, beta double"), 5, 10, 2, 10.0).collect()
    assert [r.step for r in found] == [25]


def test_mad_scores_without_spread(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0), ("a", 5.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    out = {(r.g, r.v): r.score for r in cp.mad_scores(rows, "v", ["g"]).collect()}
    assert out == {("a", 1.0): None, ("a", 5.0): math.inf, ("b", 1.0): None}


def test_adjusted_rand(spark):
    cases = {"same": ("000111", "000111"), "flip": ("000111", "111000"), "flat": ("000111", "000000"), "half": ("000111", "001122")}
    rows = [(c, i, int(x), int(y)) for c, (a, b) in cases.items() for i, (x, y) in enumerate(zip(a, b, strict=True))]
    out = {r.c: r.ari for r in ev.adjusted_rand(spark.createDataFrame(rows, "c string, node int, truth int, found int"), ["c"]).collect()}
    assert out["same"] == 1 and out["flip"] == 1 and out["flat"] == pytest.approx(0) and out["half"] == pytest.approx(0.2424, abs=1e-4)


def test_alignment(spark):
    labels = spark.createDataFrame([(0, 2), (0, 2), (1, 0), (2, 1), (2, 1), (1, 1)], "found int, truth int")
    assert {r.found: r.truth for r in ev.best_alignment(labels, 3).collect()} == {0: 2, 1: 0, 2: 1}
    rates = spark.createDataFrame([(1, 5, k, m, float(1 + 5 * (k == m == 1)), 1.0) for k in (0, 1) for m in (0, 1)], "run int, step int, k int, m int, alpha double, beta double")
    assert {(r.k, r.m): r.alpha for r in ev.align_two(rates).collect()}[0, 0] == 6.0


def test_js_flags(spark):
    rng = np.random.default_rng(1)
    rows = []
    for step, node in product(range(12), range(40)):
        x = np.clip(0.8 + rng.normal(0, 0.01), 0.01, 0.99)
        x = 1 - x if node == 7 and step == 11 else x
        rows.append((step, node, float(x), float(1 - x)))
    js = cp.js_lags(spark.createDataFrame(rows, "step int, node int, p0 double, p1 double"), 2, 2)
    assert [r.node for r in cp.js_flags(js, 2, 10, 3.5).where("flagged and step = 11").collect()] == [7]


def test_monitor(spark):
    """A node that moves is flagged once both of the steps compared lie before, and keeps its new label."""
    rng = np.random.default_rng(2)
    rows = []
    for step, node in product(range(20), range(40)):
        x = float(np.clip((0.2 if node == 7 and step >= 14 else 0.8) + rng.normal(0, 0.01), 0.01, 0.99))
        rows.append((step, node, x, 1 - x))
    out = cp.monitor(spark.createDataFrame(rows, "step int, node int, p0 double, p1 double"), 2, 3, 8, 2, 3.5).collect()
    assert [(r.step, r.node) for r in out if r.flagged] == [(15, 7)]
    assert {(r.step, r.grp) for r in out if r.node == 7} == {(s, int(s >= 15)) for s in range(3, 20)}
    assert {r.grp for r in out if r.node != 7} == {0}


def test_alignments_by_step(spark):
    rng = random.Random(3)
    rows = [(s, rng.randrange(3), rng.randrange(3)) for s in range(6) for _ in range(25)] + [(9, 7, 1)]
    labels = spark.createDataFrame(rows, "step int, found int, truth int")
    got = {(r.step, r.found): r.truth for r in ev.alignments(labels, 3).collect()}
    assert len(got) == 18
    for step in range(6):
        assert {r.found: r.truth for r in ev.best_alignment(labels.where(F.col("step") == step), 3).collect()} == {f: got[step, f] for f in range(3)}


@pytest.mark.parametrize("k", [1, 2, 4, 6])
def test_alignment_against_permutations(spark, k):
    from itertools import permutations

    rng = np.random.default_rng(k)
    for _ in range(3):
        table = rng.integers(0, 4, (k, k))
        labels = [(i, j) for i in range(k) for j in range(k) for _ in range(table[i, j])]
        want = max(permutations(range(k)), key=lambda p: (sum(table[i, t] for i, t in enumerate(p)), tuple(-x for x in p)))
        got = ev.best_alignment(spark.createDataFrame(labels, "found int, truth int"), k).collect()
        assert [r.truth for r in sorted(got, key=lambda r: r.found)] == list(want)


def test_alignment_of_twenty_groups(spark):
    order = np.random.default_rng(1).permutation(20)
    labels = spark.createDataFrame([(i, int(order[i])) for i in range(20) for _ in range(3)] + [(i, (int(order[i]) + 1) % 20) for i in range(20)], "found int, truth int")
    assert [r.truth for r in ev.best_alignment(labels, 20).orderBy("found").collect()] == order.tolist()


def test_runs_are_read_back_and_replaced(spark, tmp_path):
    path = str(tmp_path / "runs")
    for idx, run, n in ((1, 0, 3), (1, 1, 4), (2, 0, 5), (1, 0, 2)):
        nw.write_run(spark.range(n), path, "a", idx, run)
    nw.write_run(spark.range(9), path, "b", 1, 0)
    sizes = {(r.idx, r.run): r["count"] for r in nw.read_runs(spark, path, "a").groupBy("idx", "run").count().collect()}
    assert sizes == {(1, 0): 2, (1, 1): 4, (2, 0): 5}
    assert nw.read_runs(spark, path, "a", 2).count() == 5


def test_envelope_is_averaged_over_runs(spark):
    rows = [(run, 1, 0, 0, float(a), float(b)) for run, (a, b) in enumerate([(1, 1), (1, 2), (1, 4)])]
    out = ev.rate_envelope(spark.createDataFrame(rows, "run int, step int, k int, m int, alpha double, beta double")).first()
    # Gamma(1, b) is exponential: its quantiles are -ln(1 - p) / b.
    share = (1 + 1 / 2 + 1 / 4) / 3
    assert (out["mean"], out["low"], out["high"]) == pytest.approx((share, -np.log(0.975) * share, -np.log(0.025) * share))


def test_grid_files(spark, tmp_path):
    nw.write_grid(nw.parameter_grid(spark, a=[1, 2], b=[0.5, 0.25]), str(tmp_path / "grid"))
    assert nw.read_setting(spark, str(tmp_path / "grid"), 2) == {"a": 2.0, "b": 0.5}
    with pytest.raises(ValueError):
        nw.read_setting(spark, str(tmp_path / "grid"), 9)
    assert nw.find_setting(spark, str(tmp_path / "grid"), a=2, b=0.5) == 2
    for values in ({"a": 2}, {"a": 7}):
        with pytest.raises(ValueError):
            nw.find_setting(spark, str(tmp_path / "grid"), **values)


def test_streaming(spark, tmp_path):
    from eventweave.streaming.online import OnlineModel, stream_counts

    schema = "ts timestamp, src int, dst int"
    rows = [(f"2024-01-01 00:{m:02}:30", m % 4, (m * 3) % 4) for m in range(40)]
    batch = spark.createDataFrame(rows, "ts string, src int, dst int").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(2):
        batch.where(F.minute("ts") >= 20 if i else F.minute("ts") < 20).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    model = OnlineModel(on.start(spark.range(4).select(F.col("id").cast("int").alias("node")), on.Options(k=2, delta=10.0, n_cavi=1, n_sweeps=1)), "2024-01-01 00:00:00", 600)
    query = model.start(stream_counts(stream, "10 minutes", "0 seconds"), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert model.state.step == 3  # the last window isn't over
    batch_counts = ct.interval_counts(batch.select("src", "dst", (F.minute("ts") * 1.0).alias("t")), 10.0)
    _, post, _ = on.run_online(batch_counts, spark.range(4).select(F.col("id").cast("int").alias("node")), model.state.options, 3)
    assert np.array(sorted(model.state.rate_log)) == pytest.approx(np.array(sorted(tuple(r) for r in post.collect())))


def staged_tables(spark):
    import os

    from eventweave.operators.storage import shared_root

    folder = f"{shared_root(spark).removeprefix('file://')}/staged/{spark.sparkContext.applicationId}"
    return {x for x in os.listdir(folder)} if os.path.isdir(folder) else set()


@pytest.mark.parametrize("mode", ["known", "graph", "groups"])
def test_tables_of_earlier_intervals_are_deleted(spark, tmp_path, mode):
    """What a model keeps, staged and in its folder, is as much after four intervals as after two; its rates are all there."""
    import os

    from eventweave.streaming.online import OnlineModel, saved_rates

    nodes = spark.range(4).select(F.col("id").cast("int").alias("node"))
    options = on.Options(k=2, delta=10.0, mode=mode, k_prime=2, n_cavi=2, n_sweeps=2, begin="spectral")
    model, kept = OnlineModel(on.start(nodes, options), "2024-01-01 00:00:00", 600, str(tmp_path)), []
    for s in range(4):
        rows = [(f"2024-01-01 00:{10 * s:02}:00", i, (i + s) % 4, 1 + i) for i in range(4)]
        before = staged_tables(spark)
        model.take(spark.createDataFrame(rows, "at string, src int, dst int, n long").withColumn("at", F.col("at").cast("timestamp")), s)
        kept.append((len(staged_tables(spark)) - len(before), len(os.listdir(tmp_path / "tables"))))
    assert [x for x, _ in kept[1:]] == [0] * 3 and [x for _, x in kept] == [1, 2, 2, 2]
    assert sorted((r.step, r.k, r.m) for r in saved_rates(spark, str(tmp_path)).collect()) == [(s, k, m) for s in range(5) for k in (0, 1) for m in (0, 1)]
    last = np.array([[r.alpha for r in saved_rates(spark, str(tmp_path)).where("step = 4").orderBy("k", "m").collect()]]).reshape(2, 2)
    assert last == pytest.approx(model.state.params["alpha"])


@pytest.mark.parametrize("mode", ["known", "graph"])
def test_streaming_goes_on_after_a_restart(spark, tmp_path, mode):
    from eventweave.streaming.online import OnlineModel, saved_rates

    nodes = spark.range(4).select(F.col("id").cast("int").alias("node"))
    options = on.Options(k=2, delta=10.0, mode=mode, k_prime=2, n_cavi=1, n_sweeps=1)
    windows = [spark.createDataFrame([(f"2024-01-01 00:{10 * s:02}:00", i, (i + s) % 4, 1 + i) for i in range(4)], "at string, src int, dst int, n long").withColumn("at", F.col("at").cast("timestamp")) for s in range(3)]
    new = lambda folder: OnlineModel(on.start(nodes, options), "2024-01-01 00:00:00", 600, folder)
    whole = new(None)
    for i, w in enumerate(windows):
        whole.take(w, i)
    first = new(str(tmp_path / "model"))
    for i in range(2):
        first.take(windows[i], i)
    again = new(str(tmp_path / "model"))
    assert (again.state.step, again.taken) == (2, 1)
    again.take(windows[1], 1)  # taken already
    again.take(windows[2], 2)
    assert again.state.step == 3 and again.state.rate_log == []
    assert np.array(sorted(map(tuple, saved_rates(spark, str(tmp_path / "model")).collect()))) == pytest.approx(np.array(sorted(whole.state.rate_log)))
    with pytest.raises(ValueError):
        again.take(windows[0], 3)
