"""Scans, medians, the as-of join and the detector, on groups that many tasks share, against plain loops."""

import math
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventweave.functions.special import digamma_of
from eventweave.operators import changepoint as cp
from eventweave.operators import evaluate as ev
from eventweave.operators import posterior as po
from eventweave.operators import relabel as rl
from eventweave.operators.scan import affine_scan, carry_last, exact_medians


@pytest.mark.parametrize("chunk", [4, 64])
def test_affine_scan(spark, chunk):
    """300 steps in levels of 4 or 64, groups of other lengths and gaps, against a loop."""
    rng = random.Random(1)
    rows = [(g, i, rng.random() * 1.5, rng.random()) for g, n in (("a", 300), ("b", 1), ("c", 64), ("d", 65)) for i in range(n) if g != "d" or i % 3]
    out = affine_scan(spark.createDataFrame(rows, "g string, i int, m double, x double"), ["g"], "i", F.col("m"), {"x": F.col("x"), "y": F.lit(1.0)}, {"x": 2.0, "y": 0.0}, chunk)
    expected, last = [], {}
    for g, i, m, x in rows:
        a, b = last.get(g, (2.0, 0.0))
        last[g] = (m * a + x, m * b + 1)
        expected.append((g, i, *last[g]))
    got = sorted(map(tuple, out.collect()))
    assert [r[:2] for r in got] == [r[:2] for r in expected] and np.array([r[2:] for r in got]) == pytest.approx(np.array([r[2:] for r in expected]))


def test_long_recursion_is_linear_work(spark):
    """100,000 steps of one pair of groups, against a loop; its chunks are many rows, so many tasks."""
    n = 100_000
    blocks = spark.range(n).select(F.col("id").cast("int").alias("step"), F.lit(0).alias("k"), F.lit(1).alias("m"), (F.col("id") % 7).alias("n"), F.lit(3).alias("pairs"))
    got = {r.step: (r.alpha, r.beta) for r in po.rate_recursion(blocks, 0.9, 0.5).where("step % 9973 = 0 or step = 99999").collect()}
    a, b = 1.0, 1.0
    for s in range(n):
        a, b = 0.9 * (a - 1) + s % 7 + 1, 0.9 * b + 1.5
        if s in got:
            assert got[s] == pytest.approx((a, b))
    assert len(got) == 12


def test_runs_together_are_runs_alone(spark):
    """20 runs in one plan equal 20 single ones."""
    rng = np.random.default_rng(4)
    rows = [(run, step, k, m, int(rng.poisson(9)), 2) for run in range(20) for step in range(30) for k in (0, 1) for m in (0, 1)]
    blocks = spark.createDataFrame(rows, "run int, step int, k int, m int, n long, pairs long")
    got = {tuple(r)[:4]: tuple(r)[4:] for r in po.rate_recursion(blocks, 0.1, 0.5, chunk=8).collect()}
    for run in (0, 7, 19):
        alone = po.rate_recursion(blocks.where(F.col("run") == run).drop("run"), 0.1, 0.5, chunk=8).collect()
        assert len(alone) == 120
        for r in alone:
            assert got[(run, *tuple(r)[:3])] == tuple(r)[3:]


def test_medians_of_large_groups(spark):
    rng, nan, inf = random.Random(6), float("nan"), float("inf")
    groups = {
        "even": [rng.gauss(0, 1) for _ in range(600)], "odd": [rng.gauss(5, 1e-9) for _ in range(601)], "ties": [rng.choice((1.0, 2.0)) for _ in range(500)], "powers": [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300) for _ in range(701)],
        "near": [1.0 + k * 2.0**-52 for k in range(400)], "same": [-0.25] * 300, "signs": [-1.0] * 150 + [0.0] * 2 + [1.0] * 150, "ends": [-inf] * 100 + [3.0] * 90 + [inf] * 100, "tiny": [5e-324 * k for k in range(-200, 203)], "few": [3.0, 1.0], "one": [7.0], "nan": [nan] * 30 + [1.0] * 200,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("odd", None), ("none", None), (None, 4.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    plain = {r.g: r["median"] for r in df.groupBy("g").agg(F.median("v").alias("median")).collect()}
    for most in (1, 50, 10_000):
        got = {r.g: r["median"] for r in exact_medians(df, "v", ["g"], most_rows=most).collect()}
        assert got == plain, most
    assert plain["powers"] == median(groups["powers"])


def test_scores_are_the_same_counted_out(spark):
    rng = random.Random(9)
    rows = spark.createDataFrame([(rng.choice("aab"), rng.gauss(0, 3)) for _ in range(900)], "g string, v double")
    few, counted = ({(r.g, r.v): (r["median"], r.mad, r.score) for r in cp.mad_scores(rows, "v", ["g"], most).collect()} for most in (100_000, 20))
    assert counted == few


def test_a_median_of_a_million_values(spark):
    rows = spark.range(1_000_000).select(F.lit("hot").alias("g"), F.sin("id").alias("v"))
    assert exact_medians(rows, "v", ["g"]).first()["median"] == pytest.approx(float(np.median(np.sin(np.arange(1_000_000.0)))), abs=1e-12)


def test_carried_values_over_partitions(spark):
    rng = random.Random(3)
    rows = [(rng.choice((0, 0, 0, 1, rng.randrange(2, 40))), t, rng.choice((None, None, rng.randrange(9)))) for t in range(4000)]
    got = sorted((r.g, r.t, r.v) for r in carry_last(spark.createDataFrame(rows, "g int, t int, v int"), ["g"], ["t"], "v").collect())
    last, expected = {}, []
    for g, t, v in sorted(rows, key=lambda r: r[:2]):
        last[g] = v if v is not None else last.get(g)
        expected.append((g, t, last[g]))
    assert got == expected


def test_truth_of_a_node_with_many_changes(spark):
    rng = random.Random(5)
    changes = [(1, float(t), rng.randrange(4)) for t in range(5000)] + [(2, 10.0, 3), (2, 10.0, 1), (3, 9e9, 2)]
    steps = [(s, s * 500.0 - 0.5) for s in range(12)] + [(12, 10.0)]
    got = {(r.step, r.node): r.grp for r in ev.truth_at(spark.createDataFrame(changes, "node int, t double, grp int"), spark.createDataFrame(steps, "step int, t double")).collect()}
    assert len(got) == 3 * 13
    for s, at in steps:
        for node in (1, 2, 3):
            before = [(t, g) for n, t, g in changes if n == node and t <= at]
            assert got[s, node] == (max(before)[1] if before else None)


def walk(posts, burn_in, buffer, lags, limit):
    """The detector over a whole list, by places in it."""
    kl = lambda x, y: y[0] * math.log(x[1] / y[1]) - math.lgamma(x[0]) + math.lgamma(y[0]) + (x[0] - y[0]) * digamma_of(x[0]) - (x[1] - y[1]) * x[0] / x[1]
    kept, run, waiting, found = posts[burn_in : burn_in + buffer], 0, None, []
    for step in range(burn_in + buffer + 2, len(posts)):
        if waiting is not None:
            kept[waiting] = posts[step - 1 - lags]
            waiting = waiting + 1 if waiting + 1 < buffer else None
            continue
        inside = [kl(kept[i], kept[i - lag]) for lag in range(1, lags + 1) for i in range(lag, buffer)]
        mad = median(abs(v - median(inside)) for v in inside)
        off = abs(kl(posts[step], kept[-1]) - median(inside))
        if (mad > 0 and off / mad > limit) or (mad == 0 and off > 0):
            run += 1
            if run == lags:
                found.append(step + 1 - lags)
                run, waiting = 0, 0
        else:
            run, kept = 0, kept[1:] + [posts[step]]
    return found


def posteriors(means, seed):
    rng, a, b, out = np.random.default_rng(seed), 1.0, 1.0, [(1.0, 1.0)]
    for mean in means:
        a, b = 0.1 * (a - 1) + (float(rng.poisson(mean)) if mean != int(mean) else mean) + 1, 0.1 * b + 100
        out.append((a, b))
    return out


#: Two changes with a refill between, a run that an inlier breaks, a spread of zero, a short record; halves are drawn, whole numbers are taken as they are.
RECORDS = {
    (0, 0): posteriors([200.5] * 25 + [420.5] * 20 + [150.5] * 20, 8), (0, 1): posteriors([200.5] * 22 + [500.5] + [200.5] * 10 + [500.5, 200.5] * 3 + [200.5] * 10, 9),
    (1, 0): [(5.0, 2.0)] * 30 + [(6.0, 2.0)] * 9, (1, 1): posteriors([50.5] * 9, 3),
}
SETTINGS = (5, 8, 2, 8.0)


def test_detector_cases():
    found = {}
    for pair, posts in RECORDS.items():
        detector = cp.Detector(*SETTINGS)
        found[pair] = [s for s in (detector.push(*p) for p in posts) if s is not None]
        assert found[pair] == walk(posts, *SETTINGS), pair
    assert len(found[0, 0]) == 2 and found[1, 1] == [] and found[1, 0][0] == 30


def test_detector_on_a_stream_with_restarts(spark, tmp_path):
    """The stream in random batches, stopped and started anew between them, gives the rows of rate_changes()."""
    from eventweave.streaming.detector import watch_rates

    schema = "step int, k int, m int, alpha double, beta double"
    rows = [(s, k, m, a, b) for (k, m), posts in RECORDS.items() for s, (a, b) in enumerate(posts)]
    expected = sorted(map(tuple, cp.rate_changes(spark.createDataFrame(rows, schema), *SETTINGS).collect()))
    assert expected == sorted((k, m, s) for (k, m), posts in RECORDS.items() for s in walk(posts, *SETTINGS))
    rng, at, batches = random.Random(2), 0, []
    while at < 70:
        size = rng.randrange(8, 30)
        part = [r for r in rows if at <= r[0] < at + size]
        rng.shuffle(part)
        batches.append(part)
        at += size
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, part in enumerate(batches):
        spark.createDataFrame(part + (batches[i - 1][:3] if i else []), schema).coalesce(1).write.mode("append").parquet(source)  # some steps come again
        stream = spark.readStream.schema(schema).parquet(source)
        query = watch_rates(stream, *SETTINGS).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start(out)
        query.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).select("k", "m", "step").collect())) == expected


def test_nearest_stations_on_the_whole_sphere(spark):
    """Poles, the date line, a crowd within metres, two stations at one place, lonely ones; against all pairs."""
    rng = random.Random(12)
    places = [(0, 90.0, 0.0), (1, 89.9, 170.0), (2, 89.9, -10.0), (3, -90.0, 33.0), (4, 10.0, 179.99), (5, 10.0, -179.99), (6, 10.01, -180.0), (7, 10.0, -180.0), (8, 10.0, 180.0), (9, 0.0, 0.0), (10, 0.0, 0.0)]
    places += [(20 + i, 51.5 + rng.random() * 1e-4, -0.1 + rng.random() * 1e-4) for i in range(60)] + [(100 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(40)]

    def km(a, b):
        la, lo, lb, mo = map(math.radians, (*a[1:], *b[1:]))
        return 2 * 6365.079 * math.asin(min(1.0, math.sqrt(math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lo - mo) / 2) ** 2)))

    schema = "name int, latitude double, longitude double"
    for k in (1, 4):
        got = {(r.name, r["rank"]): r.km for r in rl.nearest_stations(spark.createDataFrame(places, schema), k).collect()}
        want = {(a[0], i): d for a in places for i, d in enumerate(sorted(km(a, b) for b in places if a[0] != b[0])[:k], 1)}
        assert got == pytest.approx(want, abs=1e-6)
    assert sorted((r.name, r.other) for r in rl.nearest_stations(spark.createDataFrame(places[:2], schema), 4).collect()) == [(0, 1), (1, 0)]
    assert rl.nearest_stations(spark.createDataFrame([], schema), 2).collect() == [] == rl.nearest_stations(spark.createDataFrame(places[:1], schema), 2).collect()


def test_histories_that_no_longer_matter_are_one(spark):
    """Labels that flip at random: sigma stays that of the whole matrix, and histories don't grow with the steps."""
    from eventweave.operators import online as on

    rng, n, delta = np.random.default_rng(7), 9, 50.0
    rates, rho = np.array([[4.0, 3.2], [3.5, 5.0]]), np.array([[0.4, 0.2], [0.3, 0.9]])
    group = rng.integers(0, 2, n)
    big, kinds = np.zeros((n, n)), spark.createDataFrame([(i, 0, int(group[i])) for i in range(n)], "node int, c long, g int")
    table, classes = spark.createDataFrame([(0, 0, 0.0)], "ca long, cb long, big double"), []
    for step in range(9):
        z = rng.integers(0, 2, n) if step < 4 else np.array([step % 2] * 4 + [0] * 3 + [(step // 2) % 2] * 2)
        labels = spark.createDataFrame([(i, int(z[i])) for i in range(n)], "node int, z int")
        kinds, table = on._histories(kinds.join(labels, "node"), table, rates, on.GONE / delta)
        big += rates[z][:, z]
        classes.append(kinds.select("c").distinct().count())
        assert table.count() == classes[-1] ** 2
    c = {r.node: (r.c, r.g) for r in kinds.collect()}
    kept = {(r.ca, r.cb): r.big for r in table.collect()}
    for i in range(n):
        for j in range(n):
            sigma = lambda b, r=rho[group[i], group[j]]: r * math.exp(-delta * b) / (1 - r + r * math.exp(-delta * b))
            assert sigma(kept[c[i][0], c[j][0]]) == pytest.approx(sigma(big[i, j]), abs=1e-300)
    assert max(classes) > 4 and classes[-1] <= 3


def test_intervals_tell_what_the_dense_table_tells(spark):
    from eventweave.operators import intervals as iv

    rng, rows = random.Random(14), []
    for node in range(60):
        grp = rng.randrange(3)
        for step in range(2, 22):
            grp = rng.randrange(3) if rng.random() < 0.1 else grp
            rows.append((step, node, grp))
    dense = spark.createDataFrame(rows, "step int, node int, grp int")
    spans = iv.to_intervals(dense).cache()
    changes = sum(a[1] == b[1] and a[2] != b[2] for a, b in zip(rows, rows[1:]))
    assert spans.count() == 60 + changes
    assert sorted(map(tuple, iv.to_memberships(spans).collect())) == sorted(rows)
    assert sorted(map(tuple, iv.interval_churn(spans).collect())) == sorted(map(tuple, ev.churn(dense).collect()))
    assert {(r.step, r.grp): r.n for r in iv.interval_sizes(spans).collect()} == {(s, g): sum(x == (s, n, g) for n in range(60) for x in [next(r for r in rows if r[:2] == (s, n))]) for s in range(2, 22) for g in range(3)}
    truth = spark.createDataFrame([(n, n % 4) for n in range(50)], "node int, truth int")
    got = {r.step: r.ari for r in iv.rand_by_moves(spans, truth).collect()}
    want = {r.step: r.ari for r in ev.adjusted_rand(dense.withColumnRenamed("grp", "found").join(truth, "node"), ["step"]).collect()}
    assert got == pytest.approx(want)
    moved = {(r.step, r.node, r.old, r.grp) for r in iv.moves(spans).where("old is not null and step in (5, 9)").collect()}
    assert moved == {tuple(r) for r in ev.changed_nodes(dense, [5, 9]).collect()}
    assert iv.to_intervals(dense.limit(0)).collect() == iv.interval_churn(spans.limit(0)).collect() == []


def test_tasks_of_nearest_stations_do_not_grow(spark, tmp_path, monkeypatch):
    """A table in one small file: no stage writes more rows a task than a few times TASK_ROWS, and the results are those of one large task."""
    places = [(i, -90.0 + i * 7919 % 18001 * 0.01, -180.0 + i * 104729 % 36000 * 0.01) for i in range(8000)]
    places += [(8000 + i, 12.0, 34.0) for i in range(300)]  # many at one place
    spark.createDataFrame(places, "name long, latitude double, longitude double").coalesce(1).write.parquet(str(tmp_path / "stations"))
    stations, rows = spark.read.parquet(str(tmp_path / "stations")), lambda df: sorted(map(tuple, df.select("name", "rank", "other", "km").collect()))
    want = rows(rl.nearest_stations(stations, 3))
    monkeypatch.setattr(rl, "TASK_ROWS", 10_000, raising=False)
    store, java = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: {s.stageId(): s for s in (lambda x: (x.apply(i) for i in range(x.size())))(store.stageList(None, False, False, java.new_array(java.jvm.double, 0), None))}
    before = set(stages())
    assert rows(rl.nearest_stations(stations, 3)) == want
    own = [s for i, s in stages().items() if i not in before and s.numCompleteTasks()]
    assert own and max(s.shuffleWriteRecords() / s.numCompleteTasks() for s in own) < 4 * 10_000
    assert {(n, o) for n, r, o, _ in want if n >= 8000 and r == 1} == {(8000, 8001), *((8000 + i, 8000) for i in range(1, 300))}
