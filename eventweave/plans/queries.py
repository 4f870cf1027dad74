"""Queries over the networks in the raw tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import changepoint as cp
from ..operators import counts as ct
from ..operators import evaluate as ev
from ..operators import intervals as iv
from ..operators import many
from ..operators import online as on
from ..operators import posterior as po
from ..operators import relabel as rl
from ..sources import networks as nw

DELTA, GROUPS, SOFT = 90.0, 5, 3
Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six places, as engines add in different orders. The nudge keeps decimals that end
    in a 5 at the seventh place from going either way; minus zero becomes zero."""
    return df.withColumns({c: F.round(F.col(c) + 3e-8, 6) + 0.0 for c in names})


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return ct.interval_counts(nw.trade_events(spark, sf), DELTA)


def _steps(spark: SparkSession, sf: str, delta: float = DELTA) -> int:
    """How many intervals the record has: the last shipment's and those before. One column of one table is read."""
    last = nw.table(spark, sf, "lineitem").agg(F.max(F.datediff("l_shipdate", F.lit(nw.EPOCH)))).first()[0]
    return 0 if last is None else int(last // delta) + 1


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    return nw.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("grp"))


def soft_share(node: Column, i: int) -> Column:
    return (1.0 + F.pmod(node * 7 + 3 * i, F.lit(5))) / sum((1.0 + F.pmod(node * 7 + 3 * j, F.lit(5)) for j in range(1, SOFT)), 1.0 + F.pmod(node * 7, F.lit(5)))


def _soft(spark: SparkSession, sf: str) -> DataFrame:
    node = F.col("node")
    return _groups(spark, sf).select("node", *(soft_share(node, i).alias(f"p{i}") for i in range(SOFT)))


def edge_interval_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _counts(spark, sf)


def edge_cumulative_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ct.cumulative_counts(_counts(spark, sf))


def edge_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return ct.first_seen(_counts(spark, sf))


def edge_arrival_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = ct.arrival_lists(nw.trade_events(spark, sf), DELTA)
    return rows.select("step", "src", "dst", F.array_join(F.transform("times", lambda t: t.cast("int").cast("string")), ",").alias("times"))


def transition_network(spark: SparkSession, sf: str) -> DataFrame:
    return ct.interval_counts(nw.transition_events(spark, sf), 1.0)


def bipartite_network(spark: SparkSession, sf: str) -> DataFrame:
    return ct.interval_counts(nw.user_events(spark, sf), 7.0)


def node_dense_relabel(spark: SparkSession, sf: str) -> DataFrame:
    return rl.dense_labels(nw.table(spark, sf, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"])


def known_node_filter(spark: SparkSession, sf: str) -> DataFrame:
    known = nw.table(spark, sf, "nation").where("n_regionkey <= 2").select(F.col("n_nationkey").alias("node"))
    return rl.known_only(nw.trade_events(spark, sf), known).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("t").alias("t"))


def text_normalise(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.concat(F.lit("Lansdown "), "p_name", F.lit("   ,  "), "p_type", F.lit(" road_OLD, Haggerston x"))
    return nw.table(spark, sf, "part").select("p_partkey", tx.clean_station(odd).alias("name"))


def time_to_minutes(spark: SparkSession, sf: str) -> DataFrame:
    written = F.concat(F.date_format("ts", "dd/MM/yyyy HH:mm"), F.lit("\r\n"))
    return nw.table(spark, sf, "events").select("event_id", tx.minutes_since(written, "2019-01-02").alias("minutes"))


def week_bucket(spark: SparkSession, sf: str) -> DataFrame:
    week = tx.week_of(tx.minutes_since(F.date_format("ts", "dd/MM/yyyy HH:mm"), "2024-01-01"))
    return nw.table(spark, sf, "events").groupBy(week.alias("week")).agg(F.count("*").alias("n"))


def _stations(spark: SparkSession, sf: str) -> DataFrame:
    return nw.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_name").alias("name"), (51.4 + F.col("n_nationkey") * 0.007).alias("latitude"), (-0.2 + F.pmod(F.col("n_nationkey") * 13, F.lit(25)) * 0.011).alias("longitude"))


def haversine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rl.distances(_stations(spark, sf)), "km")


def near_customers(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest other customers of each, at places all over the earth that their numbers give."""
    key = F.col("c_custkey")
    places = nw.table(spark, sf, "customer").select(key.alias("name"), (-90.0 + F.pmod(key * 7919, F.lit(18001)) * 0.01).alias("latitude"), (-180.0 + F.pmod(key * 104729, F.lit(36000)) * 0.01).alias("longitude"))
    return rounded(rl.nearest_stations(places, 3), "km")


def block_counts(spark: SparkSession, sf: str) -> DataFrame:
    return po.block_counts(_counts(spark, sf), _groups(spark, sf))


def block_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return po.block_pairs(_groups(spark, sf)).select("k", "m", (F.col("pairs") * DELTA).alias("exposure"))


def block_soft_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(po.soft_block_counts(_counts(spark, sf), _soft(spark, sf), SOFT), "n")


def _rates(spark: SparkSession, sf: str, forget: float) -> DataFrame:
    groups, steps = _groups(spark, sf), _steps(spark, sf)
    blocks = po.fill_steps(po.block_counts(_counts(spark, sf), groups), po.block_pairs(groups), steps)
    return po.rate_recursion(blocks, forget, DELTA, steps=steps)


def rate_posterior_recursion(spark: SparkSession, sf: str) -> DataFrame:
    both = [_rates(spark, sf, f).withColumn("forget", F.lit(f)) for f in (0.1, 1.0)]
    return rounded(both[0].unionByName(both[1]), "alpha", "beta")


def rate_posterior_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_rates(spark, sf, 0.1).select("step", "k", "m", (F.col("alpha") / F.col("beta")).alias("mean")), "mean")


def rate_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.rate_envelope(_rates(spark, sf, 0.1)), "mean", "low", "high")


RUNS = 4


def _run_rates(spark: SparkSession, sf: str) -> DataFrame:
    """rate_post(run, step, k, m, alpha, beta): the trades in RUNS runs by customer, nations in two groups; all runs in one plan."""
    counts = ct.interval_counts(nw.trade_events(spark, sf, RUNS), DELTA)
    groups = _groups(spark, sf).withColumn("grp", F.col("grp") % 2)
    steps = _steps(spark, sf)
    return po.rate_recursion(po.fill_steps(po.block_counts(counts, groups), po.block_pairs(groups), steps), 0.1, DELTA, steps=steps)


def rate_mean_over_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and spread of the runs' posterior mean rates."""
    rows = _run_rates(spark, sf).withColumn("rate", F.col("alpha") / F.col("beta"))
    return rounded(rows.groupBy("step", "k", "m").agg(F.count("*").alias("runs"), F.avg("rate").alias("mean"), F.min("rate").alias("least"), F.max("rate").alias("most")), "mean", "least", "most")


def aligned_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The runs' rates with groups named alike: swapped where the highest rate at step 5 lies within group 1."""
    return rounded(ev.align_two(_run_rates(spark, sf)), "alpha", "beta")


def group_dirichlet_update(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(po.dirichlet_update(po.group_mass(_soft(spark, sf), SOFT), 2.0, 0.7), "gamma")


def stick_breaking_update(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(po.stick_update(po.group_mass(_soft(spark, sf), SOFT), 1.5, 2.0, 0.7, 0.9), "omega", "nu", "log_weight")


def _sigma(spark: SparkSession, sf: str) -> DataFrame:
    """Edge probabilities after each step, of nation pairs (a table of 625 a step): rates by region, rho = 0.3."""
    nodes = _groups(spark, sf)
    pairs = nodes.select(F.col("node").alias("src"), F.col("grp").alias("k")).crossJoin(nodes.select(F.col("node").alias("dst"), F.col("grp").alias("m")))
    expected = (1 + F.col("k") + 2 * F.col("m")) * 0.125 * (F.col("step") + 1)
    rows = pairs.join(ct.first_seen(_counts(spark, sf)), ["src", "dst"], "left").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(_steps(spark, sf) - 1))))
    return rows.select("step", "src", "dst", F.when(F.col("first_step") <= F.col("step"), 1.0).otherwise(po.edge_posterior(expected, F.lit(0.3))).alias("sigma"))


def edge_sigma_posterior(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_sigma(spark, sf), "sigma")


def connection_beta_update(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(po.connection_update(_sigma(spark, sf), _groups(spark, sf), 1.2, 1.5, 0.8), "eta", "zeta")


#: Fixed parameters of the one-sweep queries: group weights, digamma differences and rates of 3 groups.
LOG_WEIGHT = [-1.0, -1.2, -0.9]
RATE = [[0.020, 0.010, 0.015], [0.012, 0.025, 0.011], [0.014, 0.013, 0.022]]
LOG_RATE = [[-3.93, -4.62, -4.21], [-4.44, -3.71, -4.53], [-4.29, -4.36, -3.84]]


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    """One sweep in every interval, from the same shares."""
    tau = _soft(spark, sf)
    sums = po.neighbour_sums(_counts(spark, sf).withColumn("w", F.lit(1.0)), tau, SOFT, by=("step", "node"))
    every = tau.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(_steps(spark, sf) - 1))))
    return po.membership_scores(every, sums, LOG_WEIGHT, LOG_RATE, RATE, DELTA, self_weight=False)


def membership_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scores(spark, sf).select("step", "node", *(f"q{i}" for i in range(SOFT))), *(f"q{i}" for i in range(SOFT)))


def membership_softmax(spark: SparkSession, sf: str) -> DataFrame:
    tempered = _scores(spark, sf).select("step", "node", *((F.col(f"q{i}") / 100).alias(f"q{i}") for i in range(SOFT)))
    return rounded(po.softmax(tempered, SOFT, ["step", "node"]), *(f"p{i}" for i in range(SOFT)))


def membership_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("step", "node", po.best_group(SOFT, "q").alias("grp"))


def gamma_kl_lag(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cp.kl_lags(_rates(spark, sf, 0.1), 2), "kl")


def rate_mad_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = cp.mad_scores(_counts(spark, sf), "n", ["src", "dst"])
    return rounded(rows.select("step", "src", "dst", "median", "mad", F.when(F.col("score") < float("inf"), F.col("score")).alias("score")), "median", "mad", "score")


def rate_changes(spark: SparkSession, sf: str) -> DataFrame:
    rates = _rates(spark, sf, 0.1).withColumn("step", F.col("step") + 1)
    return cp.rate_changes(rates.unionByName(rates.where("step = 1").withColumns({"step": F.lit(0), "alpha": F.lit(1.0), "beta": F.lit(1.0)})), 3, 6, 2, 3.0)


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """tau(step, node, p0 ..): smoothed shares of each nation's sales by the buyer's region, for every step."""
    groups = _groups(spark, sf)
    counts = _counts(spark, sf).join(groups.select(F.col("node").alias("src"), "grp"), "src")
    sums = counts.groupBy("step", F.col("dst").alias("node")).agg(*(F.sum(F.when(F.col("grp") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(GROUPS)))
    grid = groups.select("node").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(_steps(spark, sf) - 1))))
    rows = grid.join(sums, ["step", "node"], "left").na.fill(0)
    total = sum((F.col(f"n{i}") for i in range(1, GROUPS)), F.col("n0")) + float(GROUPS)
    return rows.select("step", "node", *(((F.col(f"n{i}") + 1) / total).alias(f"p{i}") for i in range(GROUPS)))


def js_divergence_lag(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(cp.js_lags(_history(spark, sf), GROUPS, 2), "js")


def js_flag(spark: SparkSession, sf: str) -> DataFrame:
    flags = cp.js_flags(cp.js_lags(_history(spark, sf), GROUPS, 2), 2, 10, 0.4)
    finite = F.when(F.col("low") < float("inf"), F.col("low"))
    return rounded(flags.where(F.col("step") < _steps(spark, sf)).withColumn("low", finite), "low")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf).select("step", "node", po.best_group(GROUPS).alias("grp"))


def adjusted_rand(spark: SparkSession, sf: str) -> DataFrame:
    truth = _groups(spark, sf).select("node", F.col("grp").alias("truth"))
    return rounded(ev.adjusted_rand(_labels(spark, sf).withColumnRenamed("grp", "found").join(truth, "node"), ["step"]), "ari")


def churn_series(spark: SparkSession, sf: str) -> DataFrame:
    return ev.churn(_labels(spark, sf))


def changed_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return ev.changed_nodes(_labels(spark, sf), [5, 12, 20])


def membership_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return iv.to_intervals(_labels(spark, sf)).withColumnsRenamed({"from": "first", "to": "last"})


def interval_churn(spark: SparkSession, sf: str) -> DataFrame:
    return iv.interval_churn(iv.to_intervals(_labels(spark, sf)))


def interval_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return iv.interval_sizes(iv.to_intervals(_labels(spark, sf)))


def rand_by_moves(spark: SparkSession, sf: str) -> DataFrame:
    truth = _groups(spark, sf).select("node", F.col("grp").alias("truth"))
    return rounded(iv.rand_by_moves(iv.to_intervals(_labels(spark, sf)), truth), "ari")


def group_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ev.group_share(_labels(spark, sf), 0, 0.6, 0.4), "share")


def carried_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels = _labels(spark, sf).withColumn("flagged", F.pmod(F.col("node") + F.col("step"), F.lit(7)) == 0)
    return cp.carry_labels(labels.where("step = 0").drop("flagged"), labels.where("step > 0"))


def truth_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's segment in force at the start of every year: their orders change it."""
    orders = nw.table(spark, sf, "orders").select(F.col("o_custkey").alias("node"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("t"), (F.col("o_orderkey") % 4).cast("int").alias("grp"))
    changes = orders.groupBy("node", "t").agg(F.max("grp").alias("grp"))
    steps = spark.sql("SELECT int(y) AS step, double(unix_timestamp(make_date(y, 1, 1))) AS t FROM (SELECT explode(sequence(1995, 2002)) AS y)")
    return ev.truth_at(changes, steps).where("grp is not null")


def label_alignment(spark: SparkSession, sf: str) -> DataFrame:
    truth = _groups(spark, sf).select("node", F.col("grp").alias("truth"))
    last = _labels(spark, sf).where(F.col("step") == _steps(spark, sf) - 1).select("node", F.col("grp").alias("found"))
    return ev.best_alignment(last.join(truth, "node"), GROUPS)


def alignment_by_step(spark: SparkSession, sf: str) -> DataFrame:
    truth = _groups(spark, sf).select("node", F.col("grp").alias("truth"))
    return ev.alignments(_labels(spark, sf).withColumnRenamed("grp", "found").join(truth, "node"), GROUPS)


def ccd_dnf(spark: SparkSession, sf: str) -> DataFrame:
    """Detection scores of a plain detector: each nation's sales are a run, flagged where an edge has at least 1.5 times its median."""
    counts = _counts(spark, sf)
    flags = counts.join(counts.groupBy("src", "dst").agg(F.median("n").alias("median")), ["src", "dst"]).where("2 * n >= 3 * median")
    flags = flags.select(F.col("src").alias("run"), (F.col("step") * 0.25).alias("t"), (F.col("dst") % 2).alias("k"), (F.floor(F.col("dst") / 2) % 2).cast("int").alias("m"))
    return rounded(ev.detection_scores(flags, _groups(spark, sf).select(F.col("node").alias("run")), 3.0, 3.4, 0, 0), "ccd", "dnf")


def param_grid(spark: SparkSession, sf: str) -> DataFrame:
    return nw.parameter_grid(spark, forget=[0.1, 0.5, 1.0], share=[0.01, 0.25, 0.5, 0.95])


def weekly_file_grid(spark: SparkSession, sf: str) -> DataFrame:
    return nw.weekly_files(spark)


def _online(spark: SparkSession, sf: str, delta: float = DELTA, **options) -> tuple[DataFrame, DataFrame, on.State]:
    counts = ct.interval_counts(nw.trade_events(spark, sf), delta)
    return on.run_online(counts, _groups(spark, sf).select("node"), on.Options(delta=delta, forget_rate=0.1, n_cavi=2, n_sweeps=3, **options), _steps(spark, sf, delta))


def online_known_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _online(spark, sf, k=3)[0]


def online_infer_groups(spark: SparkSession, sf: str) -> DataFrame:
    return _online(spark, sf, k=5, mode="groups")[1]


def online_infer_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The whole record in seven intervals of 360 days: an interval has twelve sweeps and four tables of the graph."""
    return on.edge_probabilities(_online(spark, sf, 360.0, k=2, mode="graph", k_prime=2)[2])


def runs_online(spark: SparkSession, sf: str, delta: float) -> tuple[DataFrame, DataFrame]:
    """(counts, rate_post) of the trades in RUNS runs by customer, all runs inferred at once."""
    counts = ct.interval_counts(nw.trade_events(spark, sf, RUNS), delta)
    nodes = _groups(spark, sf).select("node").withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(RUNS - 1))))
    options = on.Options(k=3, delta=delta, forget_rate=0.1, n_cavi=2, n_sweeps=3)
    return counts, many.run_many(counts, nodes, options, _steps(spark, sf, delta))[1]


def online_many_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The whole record of every run in intervals of 360 days."""
    return runs_online(spark, sf, 360.0)[1]


def group_changes(spark: SparkSession, sf: str) -> DataFrame:
    return cp.monitor(_history(spark, sf), GROUPS, 3, 8, 2, 0.4)


def station_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as stations with their places and last label, numbered by first appearance."""
    stations = _stations(spark, sf)
    return ev.station_groups(rounded(stations, "latitude", "longitude"), _labels(spark, sf).where(F.col("step") == _steps(spark, sf) - 1))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    edge_interval_counts, edge_cumulative_counts, edge_first_seen, edge_arrival_lists, transition_network, bipartite_network, node_dense_relabel, known_node_filter, text_normalise, time_to_minutes,
    week_bucket, haversine_pairs, near_customers, block_counts, block_exposure, block_soft_counts, rate_posterior_recursion, rate_posterior_mean, rate_envelope, rate_mean_over_runs, aligned_runs, group_dirichlet_update, stick_breaking_update,
    edge_sigma_posterior, connection_beta_update, membership_scores, membership_softmax, membership_argmax, gamma_kl_lag, rate_mad_score, rate_changes, js_divergence_lag, js_flag, adjusted_rand,
    churn_series, changed_nodes, membership_intervals, interval_churn, interval_sizes, rand_by_moves, group_share, carried_labels, truth_regions, label_alignment, alignment_by_step, ccd_dnf, param_grid, weekly_file_grid, online_known_graph, online_infer_groups, online_infer_graph, online_many_runs, group_changes, station_groups,
)}
