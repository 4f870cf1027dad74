"""The same queries as DuckDB SQL, written apart from the DataFrame code."""

from __future__ import annotations

from .queries import DELTA, GROUPS, LOG_RATE, LOG_WEIGHT, RATE, RUNS, SOFT

EVENTS = """ev AS (SELECT c_nationkey AS src, s_nationkey AS dst, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""
COUNTS = f"{EVENTS}, cnt AS (SELECT CAST(floor(t / {DELTA}) AS INTEGER) AS step, src, dst, count(*) AS n FROM ev GROUP BY ALL)"
GRP = "grp AS (SELECT n_nationkey AS node, n_regionkey AS grp FROM nation)"
SIZES = "sizes AS (SELECT grp, count(*) AS c FROM grp GROUP BY grp)"
PAIRS = "pairs AS (SELECT a.grp AS k, b.grp AS m, a.c * b.c AS pairs FROM sizes a, sizes b)"
BLOCKS = "blk AS (SELECT step, a.grp AS k, b.grp AS m, sum(n) AS n FROM cnt JOIN grp a ON src = a.node JOIN grp b ON dst = b.node GROUP BY ALL)"
GRID = f"grid AS (SELECT step, k, m, pairs, coalesce(n, 0) AS n FROM pairs CROSS JOIN (SELECT CAST(unnest(range((SELECT max(step) + 1 FROM cnt))) AS INTEGER) AS step) LEFT JOIN blk USING (step, k, m))"
WEIGHTS = [f"(1.0::DOUBLE + (node * 7 + {3 * i}) % 5)" for i in range(SOFT)]
TOTAL = "(" + " + ".join(WEIGHTS) + ")"
SOFT_TAU = f"tau AS (SELECT n_nationkey AS node, n_regionkey AS grp, {', '.join(f'{w} / {TOTAL} AS p{i}' for i, w in enumerate(WEIGHTS))} FROM (SELECT *, n_nationkey AS node FROM nation))"
DAY = "epoch(CAST({} AS TIMESTAMP)) / 86400.0 - epoch(TIMESTAMP '2024-01-01') / 86400.0"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE) + 3e-8, 6) + 0.0"


def rates(forget: float, name: str = "rates") -> str:
    """The recursion written out: every earlier step, by powers of the forgetting factor."""
    f = f"{forget}::DOUBLE"
    return f"""{name} AS (SELECT a.step, a.k, a.m, 1 + sum(b.n * power({f}, a.step - b.step)) AS alpha,
      power({f}, a.step + 1) + sum(b.pairs * {DELTA}::DOUBLE * power({f}, a.step - b.step)) AS beta
      FROM grid a JOIN grid b ON a.k = b.k AND a.m = b.m AND b.step <= a.step GROUP BY a.step, a.k, a.m)"""


BASE = f"WITH {COUNTS}, {GRP}, {SIZES}, {PAIRS}, {BLOCKS}, {GRID}"


#: The recursion as sums of powers of 0.1, for the trades in runs by customer and two groups of nations.
RUN_RATES = f"""WITH ev AS (SELECT o_custkey % {RUNS} AS run, c_nationkey AS src, s_nationkey AS dst, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / {DELTA}) AS INTEGER) AS step
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
  g2 AS (SELECT n_nationkey AS node, n_regionkey % 2 AS grp FROM nation),
  pr AS (SELECT a.grp AS k, b.grp AS m, count(*) AS pairs FROM g2 a, g2 b GROUP BY a.grp, b.grp),
  bl AS (SELECT run, step, a.grp AS k, b.grp AS m, count(*) AS n FROM ev JOIN g2 a ON src = a.node JOIN g2 b ON dst = b.node GROUP BY ALL),
  st AS (SELECT CAST(unnest(range((SELECT max(step) + 1 FROM ev))) AS INTEGER) AS step),
  post AS (SELECT CAST(r.run AS INTEGER) AS run, s.step, k, m, 1 + coalesce((SELECT sum(n * pow(0.1::DOUBLE, s.step - b.step)) FROM bl b WHERE b.run = r.run AND b.k = pr.k AND b.m = pr.m AND b.step <= s.step), 0) AS alpha,
    pow(0.1::DOUBLE, s.step + 1) + pairs * {DELTA} * (1 - pow(0.1::DOUBLE, s.step + 1)) / 0.9::DOUBLE AS beta FROM st s, pr, (SELECT DISTINCT run FROM ev) r)"""


def psi(x: str) -> str:
    y = f"(({x}) + 8)"
    series = " - ".join(f"1.0::DOUBLE / (({x}) + {i})" for i in range(8))
    return f"(ln{y} - 0.5::DOUBLE / {y} - 1 / (12.0::DOUBLE * {y}**2) + 1 / (120.0::DOUBLE * {y}**4) - 1 / (252.0::DOUBLE * {y}**6) + 1 / (240.0::DOUBLE * {y}**8) - 1 / (132.0::DOUBLE * {y}**10) - {series})"


SIGMA = f"""sg AS (SELECT st.step, a.node AS src, b.node AS dst, a.grp AS k, b.grp AS m, CASE WHEN s.src IS NOT NULL THEN 1.0::DOUBLE ELSE
  0.3::DOUBLE * exp(-(1 + a.grp + 2 * b.grp) * 0.125::DOUBLE * (st.step + 1)) / (0.7::DOUBLE + 0.3::DOUBLE * exp(-(1 + a.grp + 2 * b.grp) * 0.125::DOUBLE * (st.step + 1))) END AS sigma
  FROM grp a CROSS JOIN grp b CROSS JOIN (SELECT CAST(unnest(range((SELECT max(step) + 1 FROM cnt))) AS INTEGER) AS step) st LEFT JOIN (SELECT src, dst, min(step) AS first FROM cnt GROUP BY src, dst) s ON s.src = a.node AND s.dst = b.node AND s.first <= st.step)"""


def _scores() -> str:
    """One sweep as a plain triple sum over nodes and groups, self-pairs left out only for the group itself."""
    rows = " UNION ALL ".join(f"SELECT {k} AS k, {m} AS m, {RATE[k][m]}::DOUBLE AS e, {LOG_RATE[k][m]}::DOUBLE AS l, {RATE[m][k]}::DOUBLE AS eb, {LOG_RATE[m][k]}::DOUBLE AS lb" for k in range(SOFT) for m in range(SOFT))
    weights = " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(LOG_WEIGHT))
    share = "CASE m " + " ".join(f"WHEN {i} THEN b.p{i}" for i in range(SOFT)) + " END"
    return f"""WITH {COUNTS}, {SOFT_TAU}, par AS ({rows}), st AS (SELECT CAST(unnest(range((SELECT max(step) + 1 FROM cnt))) AS INTEGER) AS step),
    terms AS (
      SELECT st.step, a.node, k, {share} * (coalesce(o.n, 0) * l - CASE WHEN o.n IS NULL THEN 0 ELSE {DELTA}::DOUBLE * e END + coalesce(i.n, 0) * lb - CASE WHEN i.n IS NULL THEN 0 ELSE {DELTA}::DOUBLE * eb END) AS x
      FROM st CROSS JOIN tau a CROSS JOIN tau b CROSS JOIN par LEFT JOIN cnt o ON o.step = st.step AND o.src = a.node AND o.dst = b.node LEFT JOIN cnt i ON i.step = st.step AND i.src = b.node AND i.dst = a.node
      WHERE a.node <> b.node OR m <> k),
    own AS (SELECT st.step, a.node, k, CASE k {weights} END + coalesce(n, 0) * l - {DELTA}::DOUBLE * e AS x FROM st CROSS JOIN tau a CROSS JOIN par LEFT JOIN cnt ON cnt.step = st.step AND src = a.node AND dst = a.node WHERE m = k),
    sc AS (SELECT step, node, k, sum(x) AS q FROM (SELECT * FROM terms UNION ALL SELECT * FROM own) GROUP BY step, node, k)"""


TAU_STEPS = f"""his AS (SELECT step, g.node, {', '.join(f'(coalesce(n{i}, 0) + 1) / (coalesce(total, 0) + {GROUPS}.0::DOUBLE) AS p{i}' for i in range(GROUPS))}
  FROM grp g CROSS JOIN (SELECT CAST(unnest(range((SELECT max(step) + 1 FROM cnt))) AS INTEGER) AS step)
  LEFT JOIN (SELECT step, dst AS node, sum(n) AS total, {', '.join(f'sum(CASE WHEN grp = {i} THEN n ELSE 0 END) AS n{i}' for i in range(GROUPS))} FROM cnt JOIN grp ON node = src GROUP BY step, dst) USING (step, node)),
lab AS (SELECT step, node, {' '.join(f'CASE WHEN p{i} = greatest({", ".join(f"p{j}" for j in range(GROUPS))}) THEN {i} ELSE' for i in range(GROUPS - 1))} {GROUPS - 1} {'END ' * (GROUPS - 1)} AS grp FROM his)"""
JS = " + ".join(f"a.p{i} * ln(2 * a.p{i} / (a.p{i} + b.p{i})) + b.p{i} * ln(2 * b.p{i} / (a.p{i} + b.p{i}))" for i in range(GROUPS))
#: A share equal to its earlier value makes terms of 0, which count as 1e-300.
JS_ROWS = f"""js AS (SELECT a.step, CAST(a.step - b.step AS INTEGER) AS lag, a.node, ({JS}) / 2 AS js, la.grp <> lb.grp AS moved
  FROM his a JOIN his b ON a.node = b.node AND b.step IN (a.step - 1, a.step - 2) JOIN lab la ON la.step = a.step AND la.node = a.node JOIN lab lb ON lb.step = b.step AND lb.node = b.node)"""
OFF = "CASE WHEN mad > 0 THEN abs(x - md) / mad WHEN abs(x - md) > 0 THEN CAST('infinity' AS DOUBLE) ELSE 0 END"
HISTORY = f"WITH {COUNTS}, {GRP}, {TAU_STEPS}"

RECURSIVE = BASE.replace("WITH", "WITH RECURSIVE", 1)
#: Divergences of all pairs of a pair of groups' posteriors, as a list of lists; then the detector's walk: burn-in 3, buffer 6, 2 outliers in a row, 3 spreads.
RATE_WALK = f"""po AS (SELECT 0 AS step, k, m, 1.0::DOUBLE AS alpha, 1.0::DOUBLE AS beta FROM pairs UNION ALL SELECT step + 1, k, m, alpha, beta FROM rates),
kl AS (SELECT a.k, a.m, a.step, list(b.alpha * ln(a.beta / b.beta) - lgamma(a.alpha) + lgamma(b.alpha) + (a.alpha - b.alpha) * {psi('a.alpha')} - (a.beta - b.beta) * a.alpha / a.beta ORDER BY b.step) AS d
  FROM po a JOIN po b ON a.k = b.k AND a.m = b.m GROUP BY a.k, a.m, a.step),
al AS (SELECT k, m, list(d ORDER BY step) AS d FROM kl GROUP BY k, m),
walk AS (
  SELECT k, m, d, CAST(10 AS BIGINT) AS step, CAST([3, 4, 5, 6, 7, 8] AS BIGINT[]) AS kept, CAST(0 AS BIGINT) AS run, CAST(-1 AS BIGINT) AS waiting, CAST(NULL AS BIGINT) AS found FROM al
  UNION ALL
  SELECT k, m, d, step + 1,
    CASE WHEN waiting >= 0 THEN [CASE WHEN i = waiting + 1 THEN step - 2 ELSE kept[i] END FOR i IN range(1, 7)] WHEN far THEN kept ELSE [CASE WHEN i = 6 THEN step + 1 ELSE kept[i + 1] END FOR i IN range(1, 7)] END,
    CASE WHEN waiting >= 0 THEN run WHEN far AND run = 0 THEN 1 ELSE 0 END,
    CASE WHEN waiting = 5 THEN -1 WHEN waiting >= 0 THEN waiting + 1 WHEN far AND run = 1 THEN 0 ELSE -1 END,
    CASE WHEN waiting < 0 AND far AND run = 1 THEN step END
  FROM (SELECT *, CASE WHEN mad > 0 THEN x / mad > 3 ELSE x > 0 END AS far FROM (
    SELECT *, abs(d[step + 2][kept[6] + 1] - md) AS x, list_median([abs(v - md) FOR v IN vals]) AS mad FROM (
      SELECT *, list_median(vals) AS md FROM (
        SELECT *, list_concat([d[kept[i + 1] + 1][kept[i] + 1] FOR i IN range(1, 6)], [d[kept[i + 1] + 1][kept[i - 1] + 1] FOR i IN range(2, 6)]) AS vals FROM walk WHERE step < (SELECT max(step) + 1 FROM cnt))))))"""
#: Quantiles by bisection on the distribution function's series.
ENVELOPE = """bi AS (
  SELECT step, k, m, alpha, beta, p, 0.0::DOUBLE AS lo, alpha + 10 * sqrt(alpha) + 20 AS hi, 0 AS i FROM rates, (SELECT unnest([0.025, 0.975]::DOUBLE[]) AS p)
  UNION ALL
  SELECT step, k, m, alpha, beta, p, CASE WHEN mass < p THEN mid ELSE lo END, CASE WHEN mass < p THEN hi ELSE mid END, i + 1
  FROM (SELECT *, list_sum([exp((alpha + n) * ln(mid) - mid - lgamma(alpha + n + 1)) FOR n IN range(0, CAST(20 * sqrt(alpha) + 60 AS BIGINT))]) AS mass FROM (SELECT *, (lo + hi) / 2 AS mid FROM bi WHERE i < 55)))"""

SQL = {
    "edge_interval_counts": f"WITH {COUNTS} SELECT * FROM cnt",
    "edge_cumulative_counts": f"WITH {COUNTS} SELECT *, CAST(sum(n) OVER (PARTITION BY src, dst ORDER BY step) AS BIGINT) AS full FROM cnt".replace(" AS full", ' AS "full"'),
    "edge_first_seen": f"WITH {COUNTS} SELECT src, dst, min(step) AS first_step FROM cnt GROUP BY src, dst",
    "edge_arrival_lists": f"WITH {EVENTS} SELECT CAST(floor(t / {DELTA}) AS INTEGER) AS step, src, dst, string_agg(CAST(CAST(t AS INTEGER) AS VARCHAR), ',' ORDER BY t) AS times FROM ev GROUP BY ALL",
    "transition_network": f"""WITH x AS (SELECT event_type AS src, lead(event_type) OVER w AS dst, lead(ts) OVER w AS seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
      SELECT CAST(floor({DAY.format('seen')}) AS INTEGER) AS step, src, dst, count(*) AS n FROM x WHERE dst IS NOT NULL GROUP BY ALL""",
    "bipartite_network": f"SELECT CAST(floor(({DAY.format('ts')}) / 7.0) AS INTEGER) AS step, user_id AS src, event_type AS dst, count(*) AS n FROM events GROUP BY ALL",
    "node_dense_relabel": "SELECT user_id, row_number() OVER (ORDER BY first) - 1 AS node FROM (SELECT user_id, min({'t': ts, 'e': event_id}) AS first FROM events GROUP BY user_id)",
    "known_node_filter": f"WITH {EVENTS}, ok AS (SELECT n_nationkey FROM nation WHERE n_regionkey <= 2) SELECT src, dst, count(*) AS n, sum(t) AS t FROM ev WHERE src IN (FROM ok) AND dst IN (FROM ok) GROUP BY src, dst",
    "text_normalise": """SELECT p_partkey, replace(replace(replace(replace(regexp_replace(replace('Lansdown ' || p_name || '   ,  ' || p_type || ' road_OLD, Haggerston x', 'Lansdown ', 'Lansdowne '), ' +,', ',', 'g'),
      '  ', ' '), '_OLD', ''), ' road', ' Road'), ', Haggerston ', ', Haggerston') AS name FROM part""",
    "time_to_minutes": "SELECT event_id, epoch(date_trunc('minute', ts)) / 60.0 - epoch(TIMESTAMP '2019-01-02') / 60.0 AS minutes FROM events",
    "week_bucket": "SELECT floor((epoch(date_trunc('minute', ts)) - epoch(TIMESTAMP '2024-01-01')) / 60.0 / 1440 / 7) + 0.5::DOUBLE AS week, count(*) AS n FROM events GROUP BY ALL",
    "haversine_pairs": f"""WITH s AS (SELECT n_name AS name, 51.4::DOUBLE + n_nationkey * 0.007::DOUBLE AS la, -0.2::DOUBLE + (n_nationkey * 13 % 25) * 0.011::DOUBLE AS lo FROM nation)
      SELECT a.name AS name_1, b.name AS name_2, {r6("2 * 6365.079::DOUBLE * asin(least(1.0::DOUBLE, sqrt(power(sin((radians(a.la) - radians(b.la)) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * power(sin((radians(a.lo) - radians(b.lo)) / 2), 2))))")} AS km
      FROM s a JOIN s b ON a.name < b.name""",
    "near_customers": f"""WITH c AS (SELECT c_custkey AS name, radians(-90.0::DOUBLE + (c_custkey * 7919 % 18001) * 0.01::DOUBLE) AS la, radians(-180.0::DOUBLE + (c_custkey * 104729 % 36000) * 0.01::DOUBLE) AS lo FROM customer),
      d AS (SELECT a.name, b.name AS other, 2 * 6365.079::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((b.la - a.la) / 2), 2) + cos(a.la) * cos(b.la) * pow(sin((b.lo - a.lo) / 2), 2)))) AS km FROM c a JOIN c b ON a.name <> b.name)
      SELECT name, CAST(r AS INTEGER) AS rank, other, {r6('km')} AS km FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY km, other) AS r FROM d) WHERE r <= 3""",
    "block_counts": f"WITH {COUNTS}, {GRP}, {BLOCKS} SELECT step, k, m, CAST(n AS BIGINT) AS n FROM blk",
    "block_exposure": f"WITH {GRP}, {SIZES}, {PAIRS} SELECT k, m, pairs * {DELTA}::DOUBLE AS exposure FROM pairs",
    "block_soft_counts": f"WITH {COUNTS}, {SOFT_TAU} " + " UNION ALL ".join(f"SELECT step, {i} AS k, {j} AS m, {r6(f'sum(n * a.p{i} * b.p{j})')} AS n FROM cnt JOIN tau a ON src = a.node JOIN tau b ON dst = b.node GROUP BY step" for i in range(SOFT) for j in range(SOFT)),
    "rate_posterior_recursion": f"{BASE}, {rates(0.1, 'ra')}, {rates(1.0, 'rb')} SELECT step, k, m, {r6('alpha')} AS alpha, {r6('beta')} AS beta, 0.1::DOUBLE AS forget FROM ra UNION ALL SELECT step, k, m, {r6('alpha')}, {r6('beta')}, 1.0::DOUBLE FROM rb",
    "rate_posterior_mean": f"{BASE}, {rates(0.1)} SELECT step, k, m, {r6('alpha / beta')} AS mean FROM rates",
    "group_dirichlet_update": f"WITH {SOFT_TAU} " + " UNION ALL ".join(f"SELECT {i} AS grp, {r6(f'0.7::DOUBLE + sum(p{i}) + 1')} AS gamma FROM tau" for i in range(SOFT)),
    "stick_breaking_update": f"WITH {SOFT_TAU}, ma AS (" + " UNION ALL ".join(f"SELECT {i} AS grp, sum(p{i}) AS inside, {' + '.join(f'sum(p{j})' for j in range(i + 1, SOFT)) or '0.0::DOUBLE'} AS beyond FROM tau" for i in range(SOFT)) + f"""),
      po AS (SELECT grp, 0.7::DOUBLE * 0.5 + 0.9::DOUBLE * inside + 1 AS omega, 0.9::DOUBLE * beyond + 0.7::DOUBLE + 1 AS nu FROM ma)
      SELECT grp, {r6('omega')} AS omega, {r6('nu')} AS nu, {r6(f"{psi('omega')} - {psi('omega + nu')} + coalesce((SELECT sum({psi('b.nu')} - {psi('b.omega + b.nu')}) FROM po b WHERE b.grp < po.grp), 0)")} AS log_weight FROM po""",
    "edge_sigma_posterior": f"WITH {COUNTS}, {GRP}, {SIGMA} SELECT step, src, dst, {r6('sigma')} AS sigma FROM sg",
    "connection_beta_update": f"WITH {COUNTS}, {GRP}, {SIGMA} SELECT step, k, m, {r6('0.8::DOUBLE * 0.2 + sum(sigma) + 1')} AS eta, {r6('0.8::DOUBLE * 0.5 + sum(1 - sigma) + 1')} AS zeta FROM sg GROUP BY step, k, m",
    "membership_scores": f"{_scores()} SELECT step, node, {', '.join(r6(f'max(q) FILTER (k = {i})') + f' AS q{i}' for i in range(SOFT))} FROM sc GROUP BY step, node",
    "membership_softmax": f"{_scores()}, s2 AS (SELECT step, node, k, exp(q / 100 - max(q / 100) OVER (PARTITION BY step, node)) AS e FROM sc), s3 AS (SELECT step, node, k, e / sum(e) OVER (PARTITION BY step, node) AS p FROM s2) SELECT step, node, {', '.join(r6(f'max(p) FILTER (k = {i})') + f' AS p{i}' for i in range(SOFT))} FROM s3 GROUP BY step, node",
    "membership_argmax": f"{_scores()} SELECT step, node, CAST(arg_max(k, {{'q': q, 'k': -k}}) AS INTEGER) AS grp FROM sc GROUP BY step, node",
    "gamma_kl_lag": f"""{BASE}, {rates(0.1)} SELECT a.step, CAST(a.step - b.step AS INTEGER) AS lag, a.k, a.m,
      {r6(f"b.alpha * ln(a.beta / b.beta) - lgamma(a.alpha) + lgamma(b.alpha) + (a.alpha - b.alpha) * {psi('a.alpha')} - (a.beta - b.beta) * a.alpha / a.beta")} AS kl
      FROM rates a JOIN rates b ON a.k = b.k AND a.m = b.m AND b.step IN (a.step - 1, a.step - 2)""",
    "rate_mad_score": f"""WITH {COUNTS}, s AS (SELECT src, dst, median(n) AS median, mad(n) AS mad FROM cnt GROUP BY src, dst)
      SELECT step, src, dst, {r6('median')} AS median, {r6('mad')} AS mad, {r6("CASE WHEN mad > 0 THEN abs(n - median) / mad END")} AS score FROM cnt JOIN s USING (src, dst)""",
    "js_divergence_lag": f"{HISTORY}, {JS_ROWS} SELECT step, lag, node, {r6('js')} AS js, moved FROM js",
    "js_flag": f"""{HISTORY}, {JS_ROWS}, lj AS (SELECT *, ln(abs(CASE WHEN js = 0 THEN {GROUPS}e-300 ELSE js END)) AS x FROM js),
      st AS (SELECT s.step, median(x) AS md, mad(x) AS mad FROM (SELECT CAST(unnest(range(1, (SELECT max(step) + 1 FROM cnt))) AS INTEGER) AS step) s JOIN lj ON lj.step > s.step - 8 AND lj.step < s.step GROUP BY s.step)
      SELECT step, node, CASE WHEN min({OFF}) < 1e300 THEN {r6(f'min({OFF})')} END AS low, bool_and(moved) AS moved, min({OFF}) > 0.4 AND bool_and(moved) AS flagged FROM lj JOIN st USING (step) GROUP BY step, node""",
    "group_changes": f"""{HISTORY}, {JS_ROWS}, lj AS (SELECT *, ln(abs(CASE WHEN js = 0 THEN {GROUPS}e-300 ELSE js END)) AS x FROM js),
      st AS (SELECT s.step, median(x) AS md, mad(x) AS mad FROM (SELECT CAST(unnest(range(12, (SELECT max(step) FROM cnt))) AS INTEGER) AS step) s JOIN lj ON lj.step > s.step - 6 AND lj.step < s.step GROUP BY s.step),
      fl AS (SELECT step + 1 AS step, node FROM lj JOIN st USING (step) GROUP BY step, node HAVING min({OFF}) > 0.4 AND bool_and(moved))
      SELECT l.step, l.node, last_value(CASE WHEN l.step = 3 OR fl.node IS NOT NULL THEN l.grp END IGNORE NULLS) OVER (PARTITION BY l.node ORDER BY l.step) AS grp, fl.node IS NOT NULL AS flagged
      FROM lab l LEFT JOIN fl ON fl.step = l.step AND fl.node = l.node WHERE l.step >= 3""",
    "station_groups": f"""{HISTORY}, la AS (SELECT node, grp FROM lab WHERE step = (SELECT max(step) FROM cnt)), sh AS (SELECT grp, CAST(row_number() OVER (ORDER BY min(node)) - 1 AS INTEGER) AS shown FROM la GROUP BY grp)
      SELECT grp, node, n_name AS name, {r6("51.4::DOUBLE + n_nationkey * 0.007::DOUBLE")} AS latitude, {r6("-0.2::DOUBLE + (n_nationkey * 13 % 25) * 0.011::DOUBLE")} AS longitude, shown FROM la JOIN sh USING (grp) JOIN nation ON n_nationkey = node""",
    "adjusted_rand": f"""{HISTORY}, cells AS (SELECT step, l.grp AS f, g.grp AS t, count(*) AS n FROM lab l JOIN grp g USING (node) GROUP BY ALL),
      x AS (SELECT step, sum(n * (n - 1) / 2.0::DOUBLE) AS b, sum(n) AS total FROM cells GROUP BY step),
      y AS (SELECT step, sum(n * (n - 1) / 2.0::DOUBLE) AS a FROM (SELECT step, f, sum(n) AS n FROM cells GROUP BY step, f) GROUP BY step),
      z AS (SELECT step, sum(n * (n - 1) / 2.0::DOUBLE) AS c FROM (SELECT step, t, sum(n) AS n FROM cells GROUP BY step, t) GROUP BY step),
      w AS (SELECT step, b, a * c / (total * (total - 1) / 2.0::DOUBLE) AS e, (a + c) / 2 AS m FROM x JOIN y USING (step) JOIN z USING (step))
      SELECT step, {r6('CASE WHEN m = e THEN 1 ELSE (b - e) / (m - e) END')} AS ari FROM w""",
    "churn_series": f"{HISTORY} SELECT a.step, CAST(sum(CASE WHEN a.grp <> b.grp THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM lab a LEFT JOIN lab b ON a.node = b.node AND b.step = a.step - 1 GROUP BY a.step",
    "membership_intervals": f"""{HISTORY}, st AS (SELECT *, lag(grp) OVER (PARTITION BY node ORDER BY step) AS old, max(step) OVER (PARTITION BY node) AS fin FROM lab)
      SELECT node, step AS first, CAST(coalesce(lead(step) OVER (PARTITION BY node ORDER BY step) - 1, fin) AS INTEGER) AS last, grp FROM st WHERE old IS NULL OR old <> grp""",
    "interval_sizes": f"{HISTORY} SELECT s.step, g.grp, (SELECT count(*) FROM lab l WHERE l.step = s.step AND l.grp = g.grp) AS n FROM (SELECT DISTINCT step FROM lab) s, (SELECT DISTINCT grp FROM lab) g",
    "changed_nodes": f"{HISTORY} SELECT a.step, a.node, b.grp AS old, a.grp FROM lab a JOIN lab b ON a.node = b.node AND b.step = a.step - 1 WHERE a.step IN (5, 12, 20) AND a.grp <> b.grp",
    "group_share": f"""{HISTORY}, s AS (SELECT step, avg(CAST(grp = 0 AS INTEGER)) AS x FROM lab GROUP BY step), f AS (SELECT x AS first FROM s WHERE step = 0)
      SELECT step, {r6('CASE WHEN abs(first - 0.4::DOUBLE) < abs(first - 0.6::DOUBLE) THEN 1 - x ELSE x END')} AS share FROM s, f""",
    "carried_labels": f"{HISTORY} SELECT step, node, last_value(CASE WHEN step = 0 OR (node + step) % 7 = 0 THEN grp END IGNORE NULLS) OVER (PARTITION BY node ORDER BY step) AS grp FROM lab",
    "rate_changes": f"{RECURSIVE}, {rates(0.1)}, {RATE_WALK} SELECT k, m, CAST(found AS INTEGER) AS step FROM walk WHERE found IS NOT NULL",
    "rate_mean_over_runs": f"""{RUN_RATES} SELECT step, k, m, count(*) AS runs, {r6('avg(alpha / beta)')} AS mean, {r6('min(alpha / beta)')} AS least, {r6('max(alpha / beta)')} AS most FROM post GROUP BY step, k, m""",
    "aligned_runs": f"""{RUN_RATES}, top AS (SELECT run, arg_max(k * 2 + m, alpha / beta) = 3 AS swap FROM post WHERE step = 5 GROUP BY run)
      SELECT run, step, CASE WHEN swap THEN 1 - k ELSE k END AS k, CASE WHEN swap THEN 1 - m ELSE m END AS m, {r6('alpha')} AS alpha, {r6('beta')} AS beta FROM post JOIN top USING (run)""",
    "rate_envelope": f"{RECURSIVE}, {rates(0.1)}, {ENVELOPE} SELECT step, k, m, {r6('max(alpha / beta)')} AS mean, {r6('max(lo / beta) FILTER (p < 0.5)')} AS low, {r6('max(lo / beta) FILTER (p > 0.5)')} AS high FROM bi WHERE i = 55 GROUP BY step, k, m",
    "label_alignment": f"""{HISTORY.replace("WITH", "WITH RECURSIVE", 1)}, cells AS (SELECT l.grp AS f, g.grp AS t, count(*) AS n FROM lab l JOIN grp g USING (node) WHERE step = (SELECT max(step) FROM cnt) GROUP BY ALL),
      pe AS (SELECT CAST([] AS BIGINT[]) AS p, CAST(0 AS BIGINT) AS total UNION ALL
        SELECT list_append(p, g), CAST(total + coalesce(n, 0) AS BIGINT) FROM pe CROSS JOIN (SELECT unnest(range({GROUPS})) AS g) LEFT JOIN cells ON f = len(p) AND t = g WHERE len(p) < {GROUPS} AND NOT list_contains(p, g)),
      best AS (SELECT p FROM pe WHERE len(p) = {GROUPS} ORDER BY total DESC, p LIMIT 1)
      SELECT CAST(unnest(range({GROUPS})) AS INTEGER) AS found, CAST(unnest(p) AS INTEGER) AS truth FROM best""",
    "alignment_by_step": f"""{HISTORY.replace("WITH", "WITH RECURSIVE", 1)}, cells AS (SELECT step, l.grp AS f, g.grp AS t, count(*) AS n FROM lab l JOIN grp g USING (node) GROUP BY ALL),
      pe AS (SELECT CAST([] AS BIGINT[]) AS p UNION ALL SELECT list_append(p, g) FROM pe CROSS JOIN (SELECT unnest(range({GROUPS})) AS g) WHERE len(p) < {GROUPS} AND NOT list_contains(p, g)),
      totals AS (SELECT s.step, p, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT step FROM cells) s CROSS JOIN (SELECT p FROM pe WHERE len(p) = {GROUPS}) q LEFT JOIN cells c ON c.step = s.step AND q.p[c.f + 1] = c.t GROUP BY s.step, p),
      best AS (SELECT step, p FROM (SELECT *, row_number() OVER (PARTITION BY step ORDER BY total DESC, p) AS r FROM totals) WHERE r = 1)
      SELECT step, CAST(unnest(range({GROUPS})) AS INTEGER) AS found, CAST(unnest(p) AS INTEGER) AS truth FROM best""",
    "truth_regions": """WITH c AS (SELECT o_custkey AS node, o_orderdate AS t, max(CAST(o_orderkey % 4 AS INTEGER)) AS grp FROM orders GROUP BY ALL), y AS (SELECT CAST(unnest(range(1995, 2003)) AS INTEGER) AS step)
      SELECT step, node, arg_max(grp, t) AS grp FROM c JOIN y ON t <= make_date(step, 1, 1) GROUP BY step, node""",
    "ccd_dnf": f"""WITH {COUNTS}, f AS (SELECT src AS run, step * 0.25::DOUBLE AS t, dst % 2 AS k, (dst // 2) % 2 AS m FROM (SELECT *, median(n) OVER (PARTITION BY src, dst) AS md FROM cnt) WHERE 2 * n >= 3 * md),
      r AS (SELECT n_nationkey AS run FROM nation),
      h AS (SELECT run, count(*) AS n, max(CASE WHEN k = 0 AND m = 0 AND t > 3 AND t <= 3.6 THEN 1 ELSE 0 END) + max(CASE WHEN k = 0 AND m = 0 AND t > 3.6 THEN 1 ELSE 0 END) AS hits FROM f GROUP BY run)
      SELECT run, {r6('coalesce(hits / 2.0, 0)')} AS ccd, {r6('coalesce(hits / n, 0)')} AS dnf FROM r LEFT JOIN h USING (run)""",
    "param_grid": "SELECT row_number() OVER (ORDER BY forget, share) - 1 AS idx, * FROM (SELECT unnest([0.1, 0.5, 1.0]::DOUBLE[]) AS forget), (SELECT unnest([0.01, 0.25, 0.5, 0.95]::DOUBLE[]) AS share)",
    "weekly_file_grid": """WITH w AS (SELECT CAST(unnest(range(DATE '2019-01-02', DATE '2022-01-05', INTERVAL 7 DAYS)) AS DATE) AS d), n AS (SELECT d, row_number() OVER (ORDER BY d) - 1 + 143 AS i FROM w), x AS (SELECT d, CAST(CASE WHEN i > 246 THEN i - 1 ELSE i END AS BIGINT) AS no FROM n)
      SELECT no, no || 'JourneyDataExtract' || strftime(d, '%d%b%Y') || '-' || strftime(d + INTERVAL 6 DAYS, '%d%b%Y') || '.csv' AS name FROM x""",
}
SQL["interval_churn"], SQL["rand_by_moves"] = SQL["churn_series"], SQL["adjusted_rand"]
