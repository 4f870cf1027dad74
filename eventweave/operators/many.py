"""The online inference of many runs at once: the run is a key of every table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import digamma
from .online import Options, lean_shares
from .posterior import both_ways, neighbour_sums, node_scores, softmax
from .storage import only_kept, staged

#: Runs whose parameters are broadcast to the nodes' rows; beyond, the join is a shuffle join.
MOST_RUNS = 10_000


def run_many(counts: DataFrame, nodes: DataFrame, options: Options, steps: int, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tau history (step, run, node, p0 ..), rate_post (step, run, k, m, alpha, beta)) of every run's counts(run, step, src, dst, n) by itself; step 0 is the prior.

    What run_online() does for one run (known and groups modes, lean start), with a sweep of all runs as one join and one aggregate. The parameters are a table of
    a row for each run that Spark updates from the runs' sums, so nothing comes to the driver, and there are as many jobs as
    iterations ask for, however many runs there are. nodes: (run, node), edges: (run, src, dst) of known graphs (none: all pairs, loops too).
    Runs without counts stay in it; rows with a null run take no part. Runs may differ in size: rows are shuffled by run and node."""
    if options.mode == "graph" or options.begin != "lean" or options.tolerance is not None:
        raise ValueError("many runs at once are for the known and groups modes, with a lean start and full sweeps")
    k, spark = options.k, nodes.sparkSession
    counts = staged(counts.where("run is not null").select("run", "step", "src", "dst", "n"))
    nodes = nodes.where("run is not null").select("run", "node")
    few = nodes.select("run").distinct().limit(MOST_RUNS + 1).count() <= MOST_RUNS
    small = F.broadcast if few else lambda table: table  # tables of a row for each run
    tau = staged(nodes.select("run", "node", *lean_shares(k)))
    params = staged(nodes.select("run").distinct().select("run", *_priors(options)))
    taus, logs = [tau], [params]
    for step in range(steps):
        with only_kept(spark) as scope:
            now = counts.where(F.col("step") == step).drop("step")
            rows = now if edges is None else edges.join(now, ["run", "src", "dst"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
            ways = staged(both_ways(rows.withColumn("w", F.lit(1.0))))
            prior = params
            for _ in range(options.n_cavi):
                numbers = small(staged(_numbers(params, options)))
                for _ in range(options.n_sweeps):
                    tau = staged(_sweep(_with_sums(tau, ways, k, edges is not None, small), numbers, options))
                params = staged(_updated(params, prior, _sums(_with_sums(tau, ways, k, edges is not None, small), k), options))
            scope.keep(tau, params)
        taus.append(tau)
        logs.append(params)
    history = [t.withColumn("step", F.lit(i)) for i, t in enumerate(taus)]
    rates = [p.select(F.lit(i).alias("step"), "run", F.posexplode(F.arrays_zip("alpha", "beta")).alias("at", "x")) for i, p in enumerate(logs)]
    rates = reduce(DataFrame.unionByName, rates)
    return reduce(DataFrame.unionByName, history), rates.select("step", "run", F.floor(F.col("at") / k).cast("int").alias("k"), (F.col("at") % k).alias("m"), "x.alpha", "x.beta")


def _priors(o: Options) -> list[Column]:
    """A run's parameters before all intervals: arrays over groups, or over pairs of groups row by row."""
    even = lambda x, n: F.array_repeat(F.lit(float(x)), n)
    own = [float(x) for x in o.gamma] if isinstance(o.gamma, tuple) else [float(o.gamma)]
    gamma = F.array(*(F.lit(own[i % len(own)]) for i in range(o.k)))
    square = o.k * o.k
    return [even(o.alpha, square).alias("alpha"), even(o.beta, square).alias("beta"), even(o.forget_rate, square).alias("guard"), gamma.alias("gamma"), even(1, o.k).alias("omega"), even(o.nu, o.k).alias("nu")]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _before(values: Column, k: int) -> Column:
    """For each place, the sum of the values at places before it."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: _total(F.slice(values, F.lit(1), i)))


def _numbers(params: DataFrame, o: Options) -> DataFrame:
    """(run, w0 .., l0 .., r0 ..): expected log weights of the groups, expected log rates and rates of their pairs."""
    if o.mode == "groups":
        total = F.zip_with("omega", "nu", lambda a, b: digamma(a + b))
        rest = F.zip_with(F.transform("nu", digamma), total, lambda a, b: a - b)
        # The literal form of the sticks takes their own term off twice; see Options.literal_sticks.
        own = F.zip_with(F.transform("nu", digamma), total, lambda a, b: (b + a) if o.literal_sticks else (a - b))
        upto = F.zip_with(_before(rest, o.k), F.zip_with(rest, own, lambda a, b: a - b), lambda a, b: a + b)
        weights = F.zip_with(F.zip_with("omega", total, lambda a, b: digamma(a) - b), upto, lambda a, b: o.forget_z * (a + b))
    else:
        rows = params.withColumn("__all", digamma(_total(F.col("gamma"))))
        params, weights = rows, F.transform("gamma", lambda x: o.forget_z * (digamma(x) - F.col("__all")))
    rows = params.select("run", weights.alias("w"), F.zip_with("alpha", "beta", lambda a, b: digamma(a) - F.log(b)).alias("l"), F.zip_with("alpha", "beta", lambda a, b: a / b).alias("r"))
    return rows.select("run", *(F.col(n)[i].alias(f"{n}{i}") for n, size in (("w", o.k), ("l", o.k * o.k), ("r", o.k * o.k)) for i in range(size)))


def _with_sums(tau: DataFrame, ways: DataFrame, k: int, known: bool, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """tau with, for every run's node, the sums over its edges that neighbour_sums() names."""
    rows = tau.join(neighbour_sums(ways, tau, k, by=("run", "node")), ["run", "node"], "left").na.fill(0.0)
    if known:
        return rows
    mass = tau.groupBy("run").agg(*(F.sum(f"p{i}").alias(f"mass{i}") for i in range(k)))
    rows = rows.drop("own_w", *(f"t{way}{i}" for way in "oi" for i in range(k))).join(small(mass), "run")
    return rows.select("*", F.lit(1.0).alias("own_w"), *(F.col(f"mass{i}").alias(f"t{way}{i}") for way in "oi" for i in range(k)))


def _sweep(rows: DataFrame, numbers: DataFrame, o: Options) -> DataFrame:
    k = o.k
    square = lambda n: [[f"{n}{i * k + j}" for j in range(k)] for i in range(k)]
    scored = node_scores(rows.join(numbers, "run"), [f"w{i}" for i in range(k)], square("l"), square("r"), o.delta, self_weight=False)
    return softmax(scored, k, ["run", "node"])


def _sums(rows: DataFrame, k: int) -> DataFrame:
    """(run, mass, so, to): a run's nodes' shares added up, and the sums over nodes of p_i times the columns so and to."""
    sums = [f"array({', '.join(f'sum(p{i})' for i in range(k))}) AS mass"]
    sums += [f"array({', '.join(f'sum(p{i} * {x}{m})' for i in range(k) for m in range(k))}) AS {x}" for x in ("so", "to")]
    return rows.groupBy("run").agg(*map(F.expr, sums))


def _updated(params: DataFrame, prior: DataFrame, sums: DataFrame, o: Options) -> DataFrame:
    """The runs' parameters from those before the interval, the guards of the iteration before, and the sums."""
    old = prior.select("run", *(F.col(c).alias(f"old_{c}") for c in ("alpha", "beta", "gamma", "omega", "nu")))
    rows = params.select("run", "guard", "gamma", "omega", "nu").join(old, "run").join(sums, "run")
    faded = F.zip_with("guard", "old_alpha", lambda g, a: g * (a - 1))
    new = {
        "alpha": F.zip_with(faded, "so", lambda a, s: a + s + 1),
        "beta": F.zip_with(F.zip_with("guard", "old_beta", lambda g, b: g * b), "to", lambda b, t: b + o.delta * t),
        "guard": F.transform("to", lambda t: F.when(t < 0.1, 1.0).otherwise(float(o.forget_rate))),
    }
    if o.mode == "groups":
        whole = _total(F.col("mass"))
        beyond = F.zip_with(_before(F.col("mass"), o.k), "mass", lambda b, m: whole - b - m)
        new |= {
            "omega": F.zip_with("old_omega", "mass", lambda w, m: o.forget_u * (w - 1) + o.forget_z * m + 1),
            "nu": F.zip_with(beyond, "old_nu", lambda b, v: o.forget_z * b + o.forget_u * (v - 1) + 1),
        }
    else:
        new["gamma"] = F.zip_with("old_gamma", "mass", lambda g, m: o.forget_pi * (g - 1) + m + 1)
    return rows.select("run", *(new.get(c, F.col(c)).alias(c) for c in ("alpha", "beta", "guard", "gamma", "omega", "nu")))
