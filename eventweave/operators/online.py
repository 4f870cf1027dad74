"""Online variational inference of groups, rates, graph and number of groups.

One interval at a time: fixed-point sweeps over memberships are joins and aggregates over the
interval's edges, nodes in parallel; only the K x K parameters are on the driver. Sweeps update all
nodes at once (Jacobi). Updating them one after another is another iteration with the same fixed
points; the two were seen to end in like accuracy, not in equal numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import digamma_of
from .posterior import best_group, both_ways, neighbour_sums, node_scores, softmax, uniform_tau
from .starts import spectral_shares
from .storage import if_small, only_kept, staged, unstaged

psi = np.vectorize(digamma_of)
lgamma = np.vectorize(math.lgamma)


@dataclass
class Options:
    """Priors, forgetting factors and iteration counts; mode: known, graph (infer the edges) or groups (infer how many, up to k).

    begin: how shares begin. "lean": nearly equal, leaning by a hash; with equal priors the first sweep tells groups apart by self-loops alone.
    "spectral": by the main directions of the first interval's counts (see spectral_shares()), and rates from these shares before the first sweep.
    tolerance (known and groups modes): sweeps after an interval's first read only edges of nodes whose shares have moved by more than this since
    their neighbours heard of them (see _told()); none: all edges in every sweep."""

    k: int
    delta: float
    mode: str = "known"
    k_prime: int = 1
    alpha: float = 1.0
    beta: float = 1.0
    gamma: tuple[float, ...] | float = 1.0
    nu: float = 1.0
    xi: tuple[float, ...] | float = 1.0
    eta: float = 1.0
    zeta: float = 1.0
    sigma: float = 0.5
    forget_rate: float = 1.0
    forget_pi: float = 1.0
    forget_rho: float = 1.0
    forget_u: float = 1.0
    forget_z: float = 1.0
    n_cavi: int = 2
    n_sweeps: int = 3
    literal_sticks: bool = False
    begin: str = "lean"
    tolerance: float | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("known", "graph", "groups"):
            raise ValueError("mode is known, graph or groups: the graph and the number of groups aren't inferred together")
        if min(self.k, self.k_prime, self.n_cavi, self.n_sweeps) < 1 or min(self.alpha, self.beta, self.nu, self.eta, self.zeta, self.delta) <= 0:
            raise ValueError("counts are at least 1, parameters above 0")
        if self.tolerance is not None and (self.mode == "graph" or self.tolerance < 0):
            raise ValueError("a tolerance is at least 0, and not for the graph mode")
        if self.begin not in ("lean", "spectral"):
            raise ValueError("shares begin lean or spectral")
        if self.mode == "graph" and not 0 < self.sigma < 1:
            raise ValueError("sigma lies between 0 and 1")


@dataclass
class State:
    """The posterior after a step: tau as a table, parameters as small arrays."""

    tau: DataFrame
    options: Options
    step: int = 0
    params: dict = field(default_factory=dict)
    edges: DataFrame | None = None
    tau_prime: DataFrame | None = None
    kinds: DataFrame | None = None  # (node, c, g): label history and connection group
    big: DataFrame | None = None  # (ca, cb, big): events expected so far between histories, per unit of time
    seen: DataFrame | None = None
    ways: DataFrame | None = None  # the interval's edges from both ends
    tables: tuple = ()  # of the graph mode, see _graph_tables()
    rate_log: list[tuple] = field(default_factory=list)
    front: DataFrame | None = None  # nodes' shares, those their neighbours have heard of, and sums over neighbours; with a tolerance
    edges_read: list[int] = field(default_factory=list)  # of the last interval, by each sweep and its neighbours
    energies: list[float] = field(default_factory=list)  # of the last interval, after each iteration; see _energy()


def lean_shares(k: int, seed: int = 0) -> list[Column]:
    """p0 .. p{k-1} of a node: equal but for a hundredth more of the group that a hash of the node gives."""
    lean = [1.0 + F.when(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(k)) == i, 0.01 * k).otherwise(0.0) for i in range(k)]
    return [(x / (k + 0.01 * k)).alias(f"p{i}") for i, x in enumerate(lean)]


def start(nodes: DataFrame, options: Options, edges: DataFrame | None = None, seed: int = 0) -> State:
    """The state before the first interval; edges: those of a known graph (none: all pairs, loops too).

    Uniform shares are a fixed point of simultaneous sweeps, so each node's shares lean by a
    hundredth to a group that a hash of the node gives."""
    k = options.k
    tau = staged(nodes.select("node", *lean_shares(k, seed)))
    p = {"alpha": np.full((k, k), options.alpha), "beta": np.full((k, k), options.beta), "guard": np.full((k, k), options.forget_rate)}
    p |= {"gamma": np.resize(np.array(options.gamma, float), k), "omega": np.ones(k), "nu": np.full(k, options.nu)}
    state = State(tau, options, params=p, edges=edges)
    if options.mode == "graph":
        kp = options.k_prime
        p |= {"xi": np.resize(np.array(options.xi, float), kp), "eta": np.full((kp, kp), options.eta), "zeta": np.full((kp, kp), options.zeta)}
        state.tau_prime = staged(uniform_tau(nodes, kp))
    state.rate_log = [(0, i, j, options.alpha, options.beta) for i in range(k) for j in range(k)]
    return state


def _sigma(state: State, a: str, b: str, big: str) -> F.Column:
    """Probability of an edge without events, between connection groups a and b."""
    rho = state.params["eta"] / (state.params["eta"] + state.params["zeta"])
    kp = len(rho)
    table = F.array(*(F.lit(float(x)) for x in rho.ravel()))
    r = F.element_at(table, (F.col(a) * kp + F.col(b) + 1).cast("int"))
    gone = r * F.exp(-state.options.delta * F.col(big))
    return gone / (1 - r + gone)


def _joined(state: State, tau: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """tau with, for every node, the sums over its edges that neighbour_sums() names."""
    names = [f"{x}{i}" for i in range(k) for x in ("so", "to", "si", "ti")]
    mass = tau.agg(*(F.sum(f"p{i}").alias(f"mass{i}") for i in range(k)))
    if state.edges is not None:
        return tau.join(neighbour_sums(state.ways, tau, k), "node", "left").na.fill(0.0)
    if state.options.mode != "graph":
        sums = neighbour_sums(state.ways, tau, k)
        out = tau.join(sums, "node", "left").na.fill(0.0).crossJoin(F.broadcast(mass))
        return out.select("node", *(f"p{i}" for i in range(k)), "own_n", F.lit(1.0).alias("own_w"), *(F.col(f"mass{n[2:]}").alias(n) if n[0] == "t" else F.col(n) for n in names))
    if not state.tables:  # nothing is known of any edge yet
        s = state.options.sigma
        sums = neighbour_sums(counts.withColumn("w", F.lit(s)), tau, k)
        out = tau.join(sums, "node", "left").na.fill(0.0).crossJoin(F.broadcast(mass))
        return out.select("node", *(f"p{i}" for i in range(k)), "own_n", F.lit(s).alias("own_w"), *((s * F.col(f"mass{n[2:]}")).alias(n) if n[0] == "t" else F.col(n) for n in names))
    # Sums over kinds of nodes, put right for the edges that are known better.
    kinds, pairs, own = state.tables
    ps = ", ".join(f"p{i}" for i in range(k))
    by_kind = tau.join(kinds, "node").groupBy("cb", "gb").agg(*(F.sum(f"p{i}").alias(f"p{i}") for i in range(k)))
    base = pairs.join(by_kind, ["cb", "gb"]).groupBy("ca", "ga").agg(*(F.expr(f"sum({x} * p{i}) AS b{x}{i}") for i in range(k) for x in "oi"))
    sums = neighbour_sums(state.ways, tau, k, total="more").withColumnRenamed("own_w", "own_more")
    out = tau.join(own, "node").join(base, ["ca", "ga"]).join(sums, "node", "left").na.fill(0.0)
    fixed = [f"b{d}{i} + t{d}{i} AS t{d}{i}" for i in range(k) for d in "oi"]
    return out.selectExpr("node", *ps.split(", "), "own_n", "loop + own_more AS own_w", *(n for n in names if n[0] == "s"), *fixed)


def _graph_tables(state: State, counts: DataFrame) -> None:
    """What the sums of the graph mode need, until the edges' probabilities change.

    Nodes of one kind (label history, connection group) have the same sigma to all of another
    kind. Edges of which more is known have what their probability lies above that of their kinds."""
    kinds = state.kinds
    there = kinds.select(F.col("c").alias("ca"), F.col("g").alias("ga")).distinct()
    others = there.toDF("cb", "gb")
    back = state.big.select(F.col("ca").alias("cb"), F.col("cb").alias("ca"), F.col("big").alias("back"))
    pairs = there.join(state.big, "ca").join(others, "cb").join(back, ["ca", "cb"])
    pairs = staged(pairs.select("ca", "ga", "cb", "gb", _sigma(state, "ga", "gb", "big").alias("o"), _sigma(state, "gb", "ga", "back").alias("i")))
    ends = {e: kinds.select(F.col("node").alias(e), F.col("c").alias(f"c{x}"), F.col("g").alias(f"g{x}")) for e, x in (("src", "a"), ("dst", "b"))}
    known = state.seen.select("src", "dst", F.lit(True).alias("sure")).join(counts, ["src", "dst"], "full")
    known = known.join(ends["src"], "src").join(ends["dst"], "dst").join(pairs.drop("i"), ["ca", "ga", "cb", "gb"])
    w = F.when(F.col("sure"), 1.0).otherwise(F.col("o"))
    state.ways = staged(both_ways(known.select("src", "dst", F.coalesce("n", F.lit(0)).alias("n"), w.alias("w"), (w - F.col("o")).alias("more"))))
    own = kinds.select("node", F.col("c").alias("ca"), F.col("g").alias("ga")).join(pairs.where("ca = cb and ga = gb").select("ca", "ga", F.col("o").alias("loop")), ["ca", "ga"])
    state.tables = (staged(kinds.select("node", F.col("c").alias("cb"), F.col("g").alias("gb"))), pairs, staged(own))


def _log_weight(state: State) -> np.ndarray:
    p, o = state.params, state.options
    if o.mode != "groups":
        return o.forget_z * (psi(p["gamma"]) - digamma_of(float(p["gamma"].sum())))
    total = psi(p["omega"] + p["nu"])
    rest = psi(p["nu"]) - total
    before = np.cumsum(rest) - psi(p["nu"]) + (-total if o.literal_sticks else total)
    return o.forget_z * (psi(p["omega"]) - total + before)


def _sweeps(state: State, tau: DataFrame, counts: DataFrame) -> DataFrame:
    k, p, o = state.options.k, state.params, state.options
    # Parameters come as a row, not as literals, so that every interval runs the same generated code.
    numbers = {"w": _log_weight(state), "l": (psi(p["alpha"]) - np.log(p["beta"])).ravel(), "r": (p["alpha"] / p["beta"]).ravel()}
    row = F.broadcast(tau.sparkSession.createDataFrame([tuple(float(x) for v in numbers.values() for x in v)], ", ".join(f"{n}{i} double" for n, v in numbers.items() for i in range(len(v)))))
    square = lambda n: [[f"{n}{i * k + j}" for j in range(k)] for i in range(k)]
    scored = lambda rows: node_scores(rows.crossJoin(row), [f"w{i}" for i in range(k)], square("l"), square("r"), o.delta, self_weight=o.mode == "graph")
    if o.tolerance is not None:
        if state.front is None:
            _hear_all(state, tau, counts)
        for _ in range(o.n_sweeps):
            _told(state, staged(softmax(scored(_front_rows(state)), k, [c for c in state.front.columns if c not in {f"p{i}" for i in range(k)}])))
        return staged(state.front.select("node", *(f"p{i}" for i in range(k))))
    for _ in range(o.n_sweeps):
        tau = staged(softmax(scored(_joined(state, tau, counts, k)), k, ["node"]))  # the next sweep reads it more than once
    return tau


def _hear_all(state: State, tau: DataFrame, counts: DataFrame) -> None:
    """The front of an interval: all nodes' sums over all their edges."""
    k = state.options.k
    rows = _joined(state, tau, counts, k)
    sums = [f"{x}{i}" for i in range(k) for x in (("so", "si", "to", "ti") if state.edges is not None else ("so", "si"))]
    state.front = staged(rows.select("node", *(f"p{i}" for i in range(k)), *(F.col(f"p{i}").alias(f"h{i}") for i in range(k)), "own_n", "own_w", *sums))
    state.edges_read.append(state.ways.count())


def _front_rows(state: State) -> DataFrame:
    """The front with all sums that scores need; on a complete network those of shares alone are the same for all nodes."""
    if state.edges is not None:
        return state.front
    k = state.options.k
    mass = state.front.agg(*(F.sum(f"p{i}").alias(f"{x}{i}") for i in range(k) for x in ("to", "ti")))
    return state.front.crossJoin(F.broadcast(mass))


def _told(state: State, swept: DataFrame) -> None:
    """Puts the shares of a sweep into the front: nodes whose shares differ by more than the tolerance from what their neighbours have heard (h) tell them the difference.

    Only edges of such nodes are joined; their neighbours' sums are patched. What isn't told stays within the tolerance for each share, however many sweeps follow."""
    k = state.options.k
    far = " OR ".join(f"abs(p{i} - h{i}) > {float(state.options.tolerance)!r}D" for i in range(k))
    moved = staged(swept.where(far).select("node", *((F.col(f"p{i}") - F.col(f"h{i}")).alias(f"p{i}") for i in range(k))))
    sums = [c for c in swept.columns if c[:2] in ("so", "si", "to", "ti")]
    news = staged(neighbour_sums(state.ways, if_small(moved, 200_000), k, more=("count(*) AS edges",)).select("node", *(F.col(c).alias(f"d{c}") for c in sums), "edges"))
    state.edges_read.append(news.agg(F.sum("edges")).first()[0] or 0)
    told = swept.where(far).select("node", F.lit(True).alias("told"))
    rows = swept.join(news, "node", "left").join(told, "node", "left")
    heard = [F.when(F.col("told"), F.col(f"p{i}")).otherwise(F.col(f"h{i}")).alias(f"h{i}") for i in range(k)]
    state.front = staged(rows.select("node", *(f"p{i}" for i in range(k)), *heard, "own_n", "own_w", *((F.col(c) + F.coalesce(f"d{c}", F.lit(0.0))).alias(c) for c in sums)))


def _prime_sweeps(state: State, tau: DataFrame, counts: DataFrame) -> DataFrame:
    k, p = state.options.k_prime, state.params
    d1, d2 = (psi(p[x]) - psi(p["eta"] + p["zeta"]) for x in ("eta", "zeta"))
    weight = psi(p["xi"]) - digamma_of(float(p["xi"].sum()))
    for _ in range(state.options.n_sweeps):
        rows = _joined(state, tau, counts.limit(0), k)
        mass = tau.agg(*(F.sum(f"p{i}").alias(f"mass{i}") for i in range(k)))
        rows = rows.crossJoin(F.broadcast(mass))
        scores = []
        for a in range(k):
            own = F.col("own_w") * float(d1[a, a]) + (1 - F.col("own_w")) * float(d2[a, a])
            parts = [F.col(f"to{m}") * float(d1[a, m] - d2[a, m]) + F.col(f"ti{m}") * float(d1[m, a] - d2[m, a]) + F.col(f"mass{m}") * float(d2[a, m] + d2[m, a]) for m in range(k)]
            scores.append((float(weight[a]) + own + reduce(lambda x, y: x + y, parts) - F.col(f"p{a}") * 2 * own).alias(f"q{a}"))
        tau = staged(softmax(rows.select("node", *scores), k, ["node"]))
    return tau


def _contract(rows: DataFrame, k: int, prefixes: tuple[str, ...]) -> dict[str, np.ndarray]:
    """One row to the driver: mass, the entropy of the shares and, for each prefix, the k x k sums over nodes of p_i times the prefix's column m."""
    sums = [f"sum(p{i}) AS mass_{i}" for i in range(k)]
    sums.append(f"-sum({' + '.join(f'if(p{i} > 0, p{i} * ln(p{i}), 0D)' for i in range(k))}) AS entropy")
    sums += [f"sum(p{i} * {x}{m}) AS {x}_{i}_{m}" for x in prefixes for i in range(k) for m in range(k)]
    row = rows.agg(*map(F.expr, sums)).first()
    none = lambda v: 0.0 if v is None else float(v)
    out = {x: np.array([[none(row[f"{x}_{i}_{m}"]) for m in range(k)] for i in range(k)]) for x in prefixes}
    return out | {"mass": np.array([none(row[f"mass_{i}"]) for i in range(k)]), "entropy": none(row["entropy"])}


def _apply(state: State, prior: dict, got: dict, guard: np.ndarray) -> None:
    """The parameters of groups and rates from the sums that _contract() gave and the prior."""
    o, p, mass = state.options, state.params, got["mass"]
    if o.mode == "groups":
        p["omega"] = o.forget_u * (prior["omega"] - 1) + o.forget_z * mass + 1
        p["nu"] = o.forget_z * (mass.sum() - np.cumsum(mass)) + o.forget_u * (prior["nu"] - 1) + 1
    else:
        p["gamma"] = o.forget_pi * (prior["gamma"] - 1) + mass + 1
    p["alpha"] = guard * (prior["alpha"] - 1) + got["so"] + 1
    p["beta"] = guard * prior["beta"] + o.delta * got["to"]


def _energy(state: State, prior: dict, got: dict, guard: np.ndarray) -> float:
    """The evidence bound of an interval, up to what its counts alone give (known and groups modes).

    The sum over edges of shares times n E[ln rate] - delta E[rate], over nodes of shares times the expected log weight and of their
    entropy, less the divergences of the parameters from their (forgotten) priors. Edges and nodes come in as the sums of _contract()."""
    o, p = state.options, state.params
    a, b, c, d = p["alpha"], p["beta"], guard * (prior["alpha"] - 1) + 1, guard * prior["beta"]
    value = float(((psi(a) - np.log(b)) * got["so"] - o.delta * a / b * got["to"]).sum()) + float(got["mass"] @ _log_weight(state)) + got["entropy"]
    value -= float((c * np.log(b / d) - lgamma(a) + lgamma(c) + (a - c) * psi(a) - (b - d) * a / b).sum())
    if o.mode == "groups":
        pairs = zip((p["omega"], p["nu"]), (o.forget_u * (prior["omega"] - 1) + 1, o.forget_u * (prior["nu"] - 1) + 1), strict=True)
        (w, w0), (v, v0) = pairs
        value -= float((lgamma(w + v) - lgamma(w) - lgamma(v) - lgamma(w0 + v0) + lgamma(w0) + lgamma(v0) + (w - w0) * (psi(w) - psi(w + v)) + (v - v0) * (psi(v) - psi(w + v))).sum())
    else:
        g, g0 = p["gamma"], o.forget_pi * (prior["gamma"] - 1) + 1
        value -= math.lgamma(g.sum()) - math.lgamma(g0.sum()) + float((lgamma(g0) - lgamma(g) + (g - g0) * (psi(g) - digamma_of(float(g.sum())))).sum())
    return value


def advance(state: State, counts: DataFrame) -> State:
    """The state after one more interval, whose counts are (src, dst, n).

    Tables that the interval staged on the way are deleted; those of the state before stay, see release()."""
    o, k = state.options, state.options.k
    prior = {x: y.copy() for x, y in state.params.items()}
    new = State(state.tau, o, state.step + 1, {x: y.copy() for x, y in state.params.items()}, state.edges, state.tau_prime, state.kinds, state.big, state.seen)
    with only_kept(state.tau.sparkSession) as scope:
        counts = staged(counts.select("src", "dst", "n"))
        if o.mode != "graph":
            rows = counts if state.edges is None else state.edges.join(counts, ["src", "dst"], "left").select("src", "dst", F.coalesce("n", F.lit(0)).alias("n"))
            new.ways = staged(both_ways(rows.withColumn("w", F.lit(1.0))))
        p = new.params
        if state.step == 0 and o.begin == "spectral":
            new.tau = spectral_shares(counts, state.tau.select("node"), k)
            _apply(new, prior, _contract(_joined(new, new.tau, counts, k), k, ("so", "to")), p["guard"])
        for _ in range(o.n_cavi):
            if o.mode == "graph" and new.kinds is not None:
                _graph_tables(new, counts)
            new.tau = _sweeps(new, new.tau, counts)
            if o.mode == "graph":
                new.tau_prime = _prime_sweeps(new, new.tau_prime, counts)
            rows = _front_rows(new) if o.tolerance is not None else _joined(new, new.tau, counts, k)
            got, guard = _contract(rows, k, ("so", "to")), p["guard"]
            _apply(new, prior, got, guard)
            if o.mode != "graph":
                new.energies.append(_energy(new, prior, got, guard))
            p["guard"] = np.where(got["to"] < 0.1, 1.0, o.forget_rate)  # for the next update
            if o.mode == "graph":
                _update_graph(new, prior, counts)
        scope.keep(new.tau, new.tau_prime, new.kinds, new.big, new.seen)
    new.ways, new.front, new.tables = None, None, ()
    new.rate_log = state.rate_log + [(new.step, i, j, float(p["alpha"][i, j]), float(p["beta"][i, j])) for i in range(k) for j in range(k)]
    return new


TABLES = ("tau", "tau_prime", "kinds", "big", "seen")


def release(old: State, new: State, keep: tuple[str, ...] = ()) -> None:
    """Deletes the staged tables of a state that another has followed, but for the named ones."""
    unstaged(*(getattr(old, x) for x in TABLES if x not in keep and getattr(old, x) is not getattr(new, x)))


def _update_graph(state: State, prior: dict, counts: DataFrame) -> None:
    """Connection groups' parameters, and for every node its kind, with the events expected between label histories."""
    o, p, kp = state.options, state.params, state.options.k_prime
    got = _contract(_joined(state, state.tau_prime, counts.limit(0), kp), kp, ("to",))
    p["xi"] = prior["xi"] + got["mass"]
    p["eta"] = o.forget_rho * (prior["eta"] - 1) + got["to"] + 1
    p["zeta"] = o.forget_rho * (prior["zeta"] - 1) + np.outer(got["mass"], got["mass"]) - got["to"] + 1
    now = state.tau.select("node", best_group(o.k).alias("z")).join(state.tau_prime.select("node", best_group(kp).alias("g")), "node")
    old = state.kinds.select("node", "c") if state.kinds is not None else state.tau.select("node", F.lit(0).cast("long").alias("c"))
    before = state.big if state.big is not None else now.sparkSession.createDataFrame([(0, 0, 0.0)], "ca long, cb long, big double")
    state.kinds, state.big = _histories(staged(now.join(old, "node")), before, p["alpha"] / p["beta"], GONE / o.delta)
    seen = counts.where("n > 0").select("src", "dst")
    state.seen = staged(seen if state.seen is None else state.seen.union(seen).distinct())


#: exp(-GONE) is 0 in doubles: beyond so many expected events an edge without any is out of the question, and more of them change nothing.
GONE = 750.0


def _histories(now: DataFrame, before: DataFrame, rates: np.ndarray, most: float) -> tuple[DataFrame, DataFrame]:
    """(kinds(node, c, g), big(ca, cb, big)) after an interval with labels now(node, c, z, g; c: the history so far) and group rates.

    A history goes on by the nodes' labels; expected events stop at most. Histories whose expected events with all others agree, both ways,
    are one from then on: what lies so far back that nothing hangs on it is forgotten, and there are as many histories as
    label sequences over the intervals that still count, not over the whole record."""
    k = len(rates)
    ways = now.select("c", "z").distinct().withColumn("way", F.xxhash64("c", F.col("z").cast("long")))
    a, b = (ways.select(F.col("c").alias(f"c{x}"), F.col("z").alias(f"z{x}"), F.col("way").alias(f"way{x}")) for x in "ab")
    lam = F.element_at(F.array(*map(F.lit, rates.ravel().tolist())), (F.col("za") * k + F.col("zb") + 1).cast("int"))
    big = staged(before.join(a, "ca").join(b, "cb").select(F.col("waya").alias("ca"), F.col("wayb").alias("cb"), F.least(F.col("big") + lam, F.lit(float(most))).alias("big")))
    rows = {x: big.groupBy(F.col(x).alias("way")).agg(*(F.bit_xor(F.xxhash64(other, "big", F.lit(i))).alias(f"{x}{i}") for i in (0, 1))) for x, other in (("ca", "cb"), ("cb", "ca"))}
    marks = ["ca0", "ca1", "cb0", "cb1"]
    alike = rows["ca"].join(rows["cb"], "way")
    one = alike.groupBy(*marks).agg(F.min("way").alias("one"))
    alike = staged(alike.join(one, marks).select("way", "one"))
    kept = alike.select("one").distinct()
    kinds = now.join(ways, ["c", "z"]).join(alike, "way").select("node", F.col("one").alias("c"), "g")
    for x in ("ca", "cb"):
        big = big.join(kept.withColumnRenamed("one", x), x, "left_semi")
    return staged(kinds), staged(big.select("ca", "cb", "big"))


def edge_probabilities(state: State) -> DataFrame:
    """sigma(src, dst, sigma) of all pairs of nodes: as large as the network squared, for small networks only."""
    a, b = (state.kinds.select(F.col("node").alias(e), F.col("c").alias(f"c{x}"), F.col("g").alias(f"g{x}")) for e, x in (("src", "a"), ("dst", "b")))
    rows = a.join(state.big, "ca").join(b, "cb").join(state.seen.withColumn("sure", F.lit(True)), ["src", "dst"], "left")
    return rows.select("src", "dst", F.when(F.col("sure"), 1.0).otherwise(_sigma(state, "ga", "gb", "big")).alias("sigma"))


def run_online(counts: DataFrame, nodes: DataFrame, options: Options, steps: int, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame, State]:
    """(tau history (step, node, p0 ..), rate_post (step, k, m, alpha, beta), last state) over intervals 0 .. steps - 1 of counts(step, src, dst, n); step 0 of the histories is the prior."""
    counts, state = staged(counts), start(nodes, options, edges)
    history = [state.tau.withColumn("step", F.lit(0))]
    for step in range(steps):
        last, state = state, advance(state, counts.where(F.col("step") == step))
        release(last, state, keep=("tau",))
        history.append(state.tau.withColumn("step", F.lit(step + 1)))
    rates = counts.sparkSession.createDataFrame(state.rate_log, "step int, k int, m int, alpha double, beta double")
    return reduce(DataFrame.unionByName, history), rates, state
