"""Closed-form posterior updates with given memberships.

Memberships are hard, groups(node, grp), or soft, tau(node, p0 .. p{K-1}): a column for a group,
so that contractions over edges are plain sums that combine before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import digamma
from .scan import affine_scan


def _run(rows: DataFrame) -> list[str]:
    return [c for c in ("run",) if c in rows.columns]


def block_counts(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """blocks(step, k, m, n): events between groups by step, and by run where counts have one."""
    for end, name in (("src", "k"), ("dst", "m")):
        counts = counts.join(groups.select(F.col("node").alias(end), F.col("grp").alias(name)), end)
    return counts.groupBy(*_run(counts), "step", "k", "m").agg(F.sum("n").alias("n"))


def block_pairs(groups: DataFrame) -> DataFrame:
    """pairs(k, m, pairs): ordered pairs of nodes between groups of a complete network, self-loops too. Only group sizes are paired."""
    sizes = groups.groupBy("grp").count()
    a, b = sizes.select(F.col("grp").alias("k"), F.col("count").alias("a")), sizes.select(F.col("grp").alias("m"), F.col("count").alias("b"))
    return a.crossJoin(F.broadcast(b)).select("k", "m", (F.col("a") * F.col("b")).alias("pairs"))


def soft_block_counts(counts: DataFrame, tau: DataFrame, k: int) -> DataFrame:
    """blocks(step, k, m, n): the sums over edges of tau_src,k * tau_dst,m * n, in one pass over the edges."""
    for end, letter in (("src", "a"), ("dst", "b")):
        counts = counts.join(tau.select(F.col("node").alias(end), *(F.col(f"p{i}").alias(f"{letter}{i}") for i in range(k))), end)
    sums = [F.sum(F.col("n") * F.col(f"a{i}") * F.col(f"b{j}")).alias(f"s{i}_{j}") for i in range(k) for j in range(k)]
    wide = counts.groupBy("step").agg(*sums)
    rows = F.array(*(F.struct(F.lit(i).alias("k"), F.lit(j).alias("m"), F.col(f"s{i}_{j}").alias("n")) for i in range(k) for j in range(k)))
    return wide.select("step", F.explode(rows).alias("x")).select("step", "x.k", "x.m", "x.n")


def fill_steps(blocks: DataFrame, pairs: DataFrame, steps: int) -> DataFrame:
    """blocks with a row for every step and pair of groups (of every run), and the pairs' number."""
    grid = pairs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    for c in _run(blocks):
        grid = grid.crossJoin(blocks.select(c).distinct())
    return grid.join(blocks, [*_run(blocks), "step", "k", "m"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def rate_recursion(blocks: DataFrame, forget: float, delta: float, alpha_0: float = 1.0, beta_0: float = 1.0, chunk: int = 64, steps: int | None = None) -> DataFrame:
    """rate_post(step, k, m, alpha, beta): the gamma posterior after each step, with forgetting; of each run by itself where blocks have a column run.

    alpha' - 1 = forget (alpha - 1) + n, beta' = forget beta + delta pairs: affine maps, scanned in chunks of
    steps (see affine_scan()), so that a long record of one pair of groups is work for many tasks. steps: how many there are, if known; it spares writing short records."""
    adds = {"alpha": F.col("n"), "beta": F.col("pairs") * delta}
    post = affine_scan(blocks, [*_run(blocks), "k", "m"], "step", F.lit(float(forget)), adds, {"alpha": alpha_0 - 1, "beta": beta_0}, chunk, None if steps is None else max(steps - 1, 0))
    return post.select(*_run(blocks), F.col("step").cast("int").alias("step"), "k", "m", (F.col("alpha") + 1).alias("alpha"), "beta")


def group_mass(tau: DataFrame, k: int) -> DataFrame:
    """mass(grp, inside, beyond): sum over nodes of tau_k, and of tau_l for all l > k."""
    wide = tau.agg(*(F.sum(f"p{i}").alias(f"p{i}") for i in range(k)))
    rows = wide.select(F.explode(F.array(*(F.struct(F.lit(i).alias("grp"), F.col(f"p{i}").alias("inside")) for i in range(k)))).alias("x")).select("x.*")
    after = Window.orderBy(F.col("grp").desc()).rowsBetween(Window.unboundedPreceding, -1)  # k rows
    return rows.withColumn("beyond", F.coalesce(F.sum("inside").over(after), F.lit(0.0)))


def dirichlet_update(mass: DataFrame, prior: float, forget: float) -> DataFrame:
    """gamma = forget (gamma - 1) + mass + 1."""
    return mass.select("grp", (forget * (prior - 1) + F.col("inside") + 1).alias("gamma"))


def stick_update(mass: DataFrame, omega: float, nu: float, forget: float, forget_z: float) -> DataFrame:
    """Beta parameters of the stick-breaking shares, and the expected log weight of each group."""
    post = mass.select("grp", (forget * (omega - 1) + forget_z * F.col("inside") + 1).alias("omega"), (forget_z * F.col("beyond") + forget * (nu - 1) + 1).alias("nu"))
    total = digamma(F.col("omega") + F.col("nu"))
    before = Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)  # k rows
    rest = F.coalesce(F.sum(digamma(F.col("nu")) - total).over(before), F.lit(0.0))
    return post.withColumn("log_weight", digamma(F.col("omega")) - total + rest)


def edge_posterior(unseen_rate: Column, rho: Column) -> Column:
    """Probability of an edge on which nothing was seen: unseen_rate is the events that were to be expected."""
    none = rho * F.exp(-unseen_rate)
    return none / (1 - rho + none)


def connection_update(sigma: DataFrame, groups: DataFrame, eta_0: float, zeta_0: float, forget: float) -> DataFrame:
    """connections(k, m, eta, zeta): beta posterior of the edge probability between groups; sigma(src, dst, sigma)
    need only hold pairs with sigma > 0: the others come from the pairs' number."""
    for end, name in (("src", "k"), ("dst", "m")):
        sigma = sigma.join(groups.select(F.col("node").alias(end), F.col("grp").alias(name)), end)
    by = [c for c in ("step",) if c in sigma.columns]
    sums = sigma.groupBy(*by, "k", "m").agg(F.sum("sigma").alias("there"))
    there = F.coalesce(F.col("there"), F.lit(0.0))
    out = block_pairs(groups).join(sums, ["k", "m"], "left")
    return out.select(*by, "k", "m", (forget * (eta_0 - 1) + there + 1).alias("eta"), (forget * (zeta_0 - 1) + F.col("pairs") - there + 1).alias("zeta"))


def both_ways(counts: DataFrame, weight: str = "w") -> DataFrame:
    """(node, other, n, w, out): every edge (src, dst, n, w) as seen from either end, of its run where there is one."""
    edges = counts.select("src", "dst", "n", F.col(weight).alias("w"), *(c for c in ("run", "step", "more") if c in counts.columns))
    more = edges.columns[2:]
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *more, F.lit(True).alias("out"))
    return out.union(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), *more, F.lit(False).alias("out")))


def neighbour_sums(counts: DataFrame, tau: DataFrame, k: int, weight: str = "w", by: tuple[str, ...] = ("node",), total: str = "w", more: tuple[str, ...] = ()) -> DataFrame:
    """sums(node, own_n, own_w, so*, si*, to*, ti*): for every node, over its edges (src, dst, n, w):
    s: sum of w n tau_j, t: sum of w tau_j, o: over edges from it, i: over edges to it; own: its self-loop.

    Both directions are one join on the other end and one aggregate. counts may also come from both_ways().
    total: the column that own_w and t add up instead of w; more: further aggregates, as SQL."""
    ways = counts if "other" in counts.columns else both_ways(counts, weight)
    both = ways.join(tau.withColumnRenamed("node", "other"), [*_run(tau), "other"])
    # As SQL text: a column built call by call costs more than the work on a small network.
    sums = [f"sum(if({OWN_LOOP}, n * w, 0D)) AS own_n", f"sum(if({OWN_LOOP}, {total}, 0D)) AS own_w"]
    for i in range(k):
        for name, way in (("o", "out"), ("i", "NOT out")):
            sums += [f"sum(if({way}, w * p{i} * n, 0D)) AS s{name}{i}", f"sum(if({way}, {total} * p{i}, 0D)) AS t{name}{i}"]
    return both.groupBy(*by).agg(*map(F.expr, (*sums, *more)))


OWN_LOOP = "node = other AND out"


def membership_scores(tau: DataFrame, sums: DataFrame, log_weight: list, log_rate: list[list], rate: list[list], delta: float, self_weight: bool = True) -> DataFrame:
    """tau with score columns q0 .. q{K-1}: one Jacobi step of the membership update.

    score_k = log_weight_k + own (n L_kk - delta E_kk) + sum over m and other nodes j of
    tau_jm [n_ij L_km - delta E_km + n_ji L_mk - delta E_mk], where a node's own loop counts for
    m other than k. Parameters are numbers, or names of columns of tau. self_weight: the own term is weighed by the self-loop's probability; else it
    counts as if it were there."""
    by = [c for c in ("step", "node") if c in tau.columns and c in sums.columns]
    scores = node_scores(tau.join(sums, by, "left").na.fill(0.0), log_weight, log_rate, rate, delta, self_weight)
    return scores.select(*tau.columns, *(c for c in ("step",) if c in scores.columns and c not in tau.columns), *(f"q{i}" for i in range(len(log_weight))))


def node_scores(joined: DataFrame, log_weight: list, log_rate: list[list], rate: list[list], delta: float, self_weight: bool = True) -> DataFrame:
    """Adds the scores of membership_scores() to rows that hold a node's shares and sums."""
    k = len(log_weight)
    weight, logs, rates = ([_number(x) for x in v] for v in (log_weight, sum(log_rate, []), sum(rate, [])))
    scores = []
    for a in range(k):
        own = f"own_n * {logs[a * k + a]} - {'own_w * ' if self_weight else ''}{_number(delta)} * {rates[a * k + a]}"
        loop = f"p{a} * 2 * (own_n * {logs[a * k + a]} - own_w * {_number(delta)} * {rates[a * k + a]})"
        parts = [f"{logs[a * k + m]} * so{m} + {logs[m * k + a]} * si{m} - {_number(delta)} * ({rates[a * k + m]} * to{m} + {rates[m * k + a]} * ti{m})" for m in range(k)]
        scores.append(f"{weight[a]} + {own} + {' + '.join(parts)} - {loop} AS q{a}")
    return joined.selectExpr("*", *scores)


def _number(x: float | str) -> str:
    """A parameter in SQL: the name of a column, or a double."""
    return x if isinstance(x, str) else f"({float(x)!r}D)"


def softmax(scores: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """p0 .. p{K-1} from q0 .. q{K-1}, each node for itself."""
    top = f"greatest({', '.join(f'q{i}' for i in range(k))})" if k > 1 else "q0"
    shifted = scores.selectExpr(*keep, *(f"exp(q{i} - {top}) AS e{i}" for i in range(k)))
    return shifted.selectExpr(*keep, *(f"e{i} / ({' + '.join(f'e{j}' for j in range(k))}) AS p{i}" for i in range(k)))


def best_group(k: int, letter: str = "p") -> Column:
    """The group of the largest share, ties to the lowest."""
    best = F.array_max(F.array(*(F.struct(F.col(f"{letter}{i}").alias("p"), F.lit(-i).alias("i")) for i in range(k))))
    return -best["i"]


def uniform_tau(nodes: DataFrame, k: int) -> DataFrame:
    return nodes.select("node", *(F.lit(1.0 / k).alias(f"p{i}") for i in range(k)))
