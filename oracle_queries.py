"""DuckDB twins of the registered queries. Each starts from the same visit table, written here on its own as a CTE."""

from __future__ import annotations

VISITS = """
WITH base AS (
  SELECT
    CASE WHEN o_orderkey IS NOT NULL THEN printf('P%09d', o_orderkey) END AS patient_id,
    CASE WHEN o_orderkey % 997 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS admission_date,
    CASE WHEN o_orderkey % 89 = 0 THEN NULL
         ELSE strftime(TIMESTAMP '1970-01-01' + to_seconds((o_orderkey * 7919) % 86400), '%H:%M:%S')
    END AS admission_time,
    c_name AS patient_name,
    CASE o_orderstatus WHEN 'F' THEN 'Female' WHEN 'O' THEN 'Male' ELSE 'Other' END AS gender,
    CAST(o_custkey % 101 AS INT) AS age,
    r_name AS race,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN 'None' ELSE c_mktsegment END AS department_referral,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH')
           OR (o_orderpriority = '3-MEDIUM' AND o_orderkey % 2 = 0)
         THEN 'Admission' ELSE 'Not Admission' END AS admission_flag,
    CASE WHEN o_orderkey % 10 < 3
         THEN CAST(floor(o_orderkey / 10) % 7 + floor((500000 - o_totalprice) / 100000) AS DOUBLE)
    END AS satisfaction_score,
    CASE WHEN o_orderkey % 211 = 0 THEN NULL
         ELSE CAST(floor(o_totalprice / 8000) AS INT) + CASE WHEN o_orderkey % 97 = 0 THEN 120 ELSE 0 END
    END AS wait_time,
    CASE WHEN o_orderkey % 89 = 0 THEN NULL
         ELSE CAST(floor(((o_orderkey * 7919) % 86400) / 3600) AS INT) END AS hour
  FROM orders
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
),
visits AS (
  SELECT *,
    CAST(year(admission_date) AS INT) AS year,
    CAST(month(admission_date) AS INT) AS month,
    monthname(admission_date) AS month_name,
    dayname(admission_date) AS day_of_week,
    CAST(coalesce(weekofyear(admission_date), 0) AS INT) AS week_number,
    CASE WHEN hour IS NULL THEN 'Unknown'
         WHEN hour BETWEEN 6 AND 11 THEN 'Morning (6–12)'
         WHEN hour BETWEEN 12 AND 17 THEN 'Afternoon (12–18)'
         WHEN hour BETWEEN 18 AND 23 THEN 'Evening (18–24)'
         ELSE 'Night (0–6)' END AS time_of_day,
    CASE WHEN age <= 0 OR age > 120 OR age IS NULL THEN NULL
         WHEN age <= 12 THEN 'Child (0-12)' WHEN age <= 17 THEN 'Teen (13-17)'
         WHEN age <= 35 THEN 'Young Adult (18-35)' WHEN age <= 50 THEN 'Adult (36-50)'
         WHEN age <= 65 THEN 'Middle Age (51-65)' ELSE 'Senior (65+)' END AS age_group,
    CASE WHEN wait_time <= 0 OR wait_time > 999 OR wait_time IS NULL THEN NULL
         WHEN wait_time <= 20 THEN 'Short (<20 min)' WHEN wait_time <= 40 THEN 'Moderate (20-40 min)'
         WHEN wait_time <= 60 THEN 'Long (40-60 min)' ELSE 'Very Long (60+ min)' END AS wait_category,
    admission_flag = 'Admission' AS is_admitted,
    department_referral <> 'None' AS has_referral,
    coalesce(satisfaction_score, (SELECT median(satisfaction_score) FROM base)) AS satisfaction_score_filled
  FROM base
)"""

# The label lists, bin edges and thresholds below are fixed values, the same as in ``visitflow/sources/schema.py``.
# Irrational offsets: no visit lies as far from one centroid as from another.
CENTROIDS = ((2.0137, 1.0271), (7.0419, 1.5113), (3.0293, 5.0377), (8.0511, 9.0173))

# Shared fragments of the grouped SQL reports.
RATE = "round(100.0 * count(*) FILTER (admission_flag = 'Admission') / count(*), 2) AS admission_rate_pct"
WAIT = "round(avg(wait_time), 2)"
SCORE = "round(avg(satisfaction_score), 2)"


def even(expr: str, digits: int = 2) -> str:
    """Half-even rounding by scaling."""
    scale = float(10**digits)
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def _long(dimensions: tuple[str, ...], select: str, where: str = "true") -> str:
    """One grouped query per dimension, stacked."""
    parts = [
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS key, {select} FROM visits "
        f"WHERE {d} IS NOT NULL AND {where} GROUP BY {d}"
        for d in dimensions
    ]
    return "\nUNION ALL\n".join(parts)


def _box(value: str, group: str, source: str = "visits") -> str:
    return f""", quartiles AS (
      SELECT {group}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
             quantile_cont({value}, 0.75) AS q3
      FROM {source} WHERE {value} IS NOT NULL AND {group} IS NOT NULL GROUP BY {group}
    ), fenced AS (
      SELECT v.{group}, v.{value}, q1, median, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi
      FROM {source} v JOIN quartiles q ON v.{group} = q.{group} WHERE v.{value} IS NOT NULL
    )"""


def _box_rows(value: str, group: str, kind: str) -> str:
    inside = f"{value} BETWEEN lo AND hi"
    return f"""
    SELECT {group}, q1, median, q3, count(*) AS count,
           min({value}) FILTER ({inside}) AS low_whisker, max({value}) FILTER ({inside}) AS high_whisker,
           count(*) FILTER (NOT {inside}) AS outliers
    FROM fenced GROUP BY {group}, q1, median, q3"""


def _outlier_rows(value: str, group: str) -> str:
    return f"""
    SELECT {group}, {value}, count(*) AS count FROM fenced
    WHERE {value} NOT BETWEEN lo AND hi GROUP BY {group}, {value}"""


IQR = """, bounds AS (
  SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound
  FROM (SELECT quantile_cont(wait_time, 0.25) AS q1, quantile_cont(wait_time, 0.75) AS q3 FROM visits)
), outliers AS (
  SELECT v.*, CASE WHEN wait_time > upper_bound THEN 'High Wait' ELSE 'Unusually Low Wait' END AS anomaly_type
  FROM visits v, bounds WHERE wait_time < lower_bound OR wait_time > upper_bound
)"""

RANKED = """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY is_admitted ORDER BY md5('42|' || patient_id)) AS rn,
         count(*) OVER (PARTITION BY is_admitted) AS n,
         row_number() OVER (ORDER BY md5('42|' || patient_id)) AS rn_all, count(*) OVER () AS n_all
  FROM visits
)"""

_CATEGORIES = ("gender", "race", "department_referral", "time_of_day", "day_of_week")
_NUMBERS = ("age", "hour", "wait_time")
_SEGMENT = ("age", "wait_time", "satisfaction_score_filled", "hour", "is_admitted", "has_referral")


def _codes() -> str:
    parts = [
        f"SELECT '{c}' AS feature, label, dense_rank() OVER (ORDER BY label) - 1 AS code "
        f"FROM (SELECT DISTINCT coalesce({c}, 'nan') AS label FROM visits)"
        for c in _CATEGORIES
    ]
    return ", codes AS (" + " UNION ALL ".join(parts) + ")"


def _feature_matrix() -> str:
    joins = "\n".join(
        f"JOIN codes k{i} ON k{i}.feature = '{c}' AND k{i}.label = coalesce(v.{c}, 'nan')"
        for i, c in enumerate(_CATEGORIES)
    )
    codes = ", ".join(f"CAST(k{i}.code AS DOUBLE) AS {c}" for i, c in enumerate(_CATEGORIES))
    numbers = ", ".join(
        f"CAST(coalesce(v.{c}, (SELECT median({c}) FROM visits)) AS DOUBLE) AS {c}" for c in _NUMBERS
    )
    return f"{_codes()} SELECT v.patient_id, {codes}, {numbers} FROM visits v {joins}"


def _segment_features() -> str:
    imputed = ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM visits)) AS {c}" for c in _SEGMENT
    )
    scaled = ", ".join(
        f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) + 0.0 AS {c}" for c in _SEGMENT
    )
    return f", imputed AS (SELECT patient_id, {imputed} FROM visits) SELECT patient_id, {scaled} FROM imputed"


def _lloyd(k: int = 4, starts: int = 10, unit: int = 1_000_000, rounds: int = 300) -> str:
    """K-Means in whole units from visits of lowest hash: one row of ``steps`` for each round, start and centre."""
    d = range(len(_SEGMENT))
    imputed = ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM visits)) AS {c}" for c in _SEGMENT
    )
    scaled = ", ".join(
        f"CAST(round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () * {unit}) AS BIGINT) AS x{j}"
        for j, c in enumerate(_SEGMENT)
    )
    x, c, o = (", ".join(f"{name}{j}" for j in d) for name in "xco")
    far = " + ".join(f"(CAST(x{j} AS DOUBLE) - c{j}) * (CAST(x{j} AS DOUBLE) - c{j})" for j in d)
    means = ", ".join(
        f"coalesce(CAST(floor(CAST(2 * sum(n * x{j}) FILTER (best) + sum(n) FILTER (best) AS DOUBLE) "
        f"/ (2 * sum(n) FILTER (best))) AS BIGINT), c{j}) AS m{j}" for j in d
    )
    moved = " + ".join(f"pow(CAST(m{j} AS DOUBLE) - c{j}, 2)" for j in d)
    return f""", imputed AS (SELECT patient_id, {imputed} FROM visits),
scaled AS MATERIALIZED (SELECT patient_id, {scaled} FROM imputed),
points AS MATERIALIZED (SELECT row_number() OVER () AS point, * FROM (SELECT {x}, count(*) AS n FROM scaled GROUP BY {x})),
chosen AS (
  SELECT (r - 1) // {k} AS start, (r - 1) % {k} AS cluster, {", ".join(f"x{j} AS c{j}" for j in d)} FROM (
    SELECT *, row_number() OVER (ORDER BY md5('42|' || patient_id), {x}) AS r FROM scaled QUALIFY r <= {k * starts}
  )
), steps AS (
  SELECT 0 AS step, start, cluster, {c}, true AS open FROM chosen
  UNION ALL
  SELECT step + 1, start, cluster, {", ".join(f"m{j}" for j in d)},
    sum({moved}) OVER (PARTITION BY start) >= {1e-4 * unit**2}
  FROM (
    SELECT step, start, cluster, {c}, {means} FROM (
      SELECT *, row_number() OVER (PARTITION BY start, point ORDER BY {far}, cluster) = 1 AS best
      FROM steps JOIN points ON true WHERE open AND step < {rounds}
    ) GROUP BY step, start, cluster, {c}
  )
), last AS MATERIALIZED (SELECT * FROM steps QUALIFY step = max(step) OVER (PARTITION BY start)),
costs AS (
  SELECT start, sum(n * CAST(d AS DECIMAL(38, 0))) AS cost FROM (
    SELECT start, n, min({far}) AS d FROM last JOIN points ON true GROUP BY start, point, n
  ) GROUP BY start
), centres AS (SELECT * FROM last WHERE start = (SELECT start FROM costs ORDER BY cost, start LIMIT 1)),
placed AS (
  SELECT {x}, CAST(cluster AS INT) AS cluster FROM points JOIN centres ON true
  QUALIFY row_number() OVER (PARTITION BY point ORDER BY {far}, cluster) = 1
), clustered AS (
  SELECT v.*, cluster FROM visits v JOIN scaled USING (patient_id) JOIN placed USING ({x})
)"""


def _assigned(wanted: str = "") -> str:
    """Visits assigned to the nearest of four fixed centroids in (age / 10, wait / 10)."""
    points = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(CENTROIDS))
    out = wanted.replace("sum(distance)", "round(sum(distance), 2)") or "patient_id, cluster"
    return f""", centroids(cluster, x, y) AS (VALUES {points}), near AS (
      SELECT patient_id, CAST(cluster AS INT) AS cluster,
             pow(age / 10.0 - x, 2) + pow(wait_time / 10.0 - y, 2) AS distance,
             row_number() OVER (PARTITION BY patient_id ORDER BY pow(age / 10.0 - x, 2) + pow(wait_time / 10.0 - y, 2),
                                cluster) AS rn
      FROM visits, centroids WHERE wait_time IS NOT NULL
    ) SELECT {out} FROM near WHERE rn = 1"""


# Stand-in predictions that depend on the data only, for the metric queries.
PREDICTED = """, predicted AS (
  SELECT CAST(is_admitted AS INT) AS label, CAST(coalesce(wait_time, 0) > 30 AS INT) AS prediction FROM visits
)"""

REPORT = PREDICTED + """, classes AS (
  SELECT c AS class, count(*) FILTER (label = c AND prediction = c) AS hit,
         count(*) FILTER (prediction = c) AS guessed, count(*) FILTER (label = c) AS support
  FROM predicted, (VALUES (0), (1)) AS t(c) GROUP BY c
), scores AS (
  SELECT CAST(class AS VARCHAR) AS class, CASE WHEN guessed = 0 THEN 0 ELSE hit / guessed END AS precision,
         CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall,
         CASE WHEN guessed + support = 0 THEN 0 ELSE 2 * hit / (guessed + support) END AS f1, support, hit
  FROM classes
)"""


def _quality() -> str:
    rules = {
        "patient_id_present": "patient_id IS NULL",
        "admission_date_present": "admission_date IS NULL",
        "admission_flag_present": "admission_flag IS NULL",
        "admission_flag_allowed": "admission_flag NOT IN ('Admission', 'Not Admission')",
        "age_not_negative": "age < 0",
        "age_plausible": "age > 120",
        "score_in_range": "satisfaction_score NOT BETWEEN 0 AND 10",
        "wait_not_negative": "wait_time < 0",
        "hour_in_range": "hour NOT BETWEEN 0 AND 23",
        "row_not_empty": "patient_id IS NULL AND admission_date IS NULL AND age IS NULL AND gender IS NULL",
    }
    parts = [f"SELECT '{r}' AS rule, count(*) FILTER ({bad}) AS violations FROM visits" for r, bad in rules.items()]
    parts.append(
        "SELECT 'patient_id_unique' AS rule, count(patient_id) - count(DISTINCT patient_id) AS violations FROM visits"
    )
    return " UNION ALL ".join(parts)


def _profile() -> str:
    kinds = {
        "patient_id": "string", "admission_date": "date", "admission_time": "string", "patient_name": "string",
        "gender": "string", "age": "int", "race": "string", "department_referral": "string",
        "admission_flag": "string", "satisfaction_score": "double", "wait_time": "int", "year": "int",
        "month": "int", "month_name": "string", "day_of_week": "string", "week_number": "int", "hour": "int",
        "time_of_day": "string", "age_group": "string", "wait_category": "string", "is_admitted": "boolean",
        "satisfaction_score_filled": "double", "has_referral": "boolean",
    }
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{kind}' AS type, count(*) - count({c}) AS missing, "
        f"{even(f'100.0 * (count(*) - count({c})) / count(*)')} AS missing_pct, count(*) AS n_rows, "
        f"CAST({len(kinds)} AS INT) AS n_columns FROM visits"
        for c, kind in kinds.items()
    )


_BROWSE = (
    "patient_id, admission_date, gender, age, race, department_referral, admission_flag, wait_time, "
    "satisfaction_score, time_of_day, age_group"
)
_ALERT = "patient_id, age, gender, race, department_referral, wait_time, satisfaction_score"
_ALERT_ROWS = "FROM visits WHERE wait_time > 50 AND is_admitted ORDER BY wait_time DESC, patient_id LIMIT"
_RACE = f"SELECT race, count(*) AS total, count(*) FILTER (is_admitted) AS admitted, {RATE} FROM visits GROUP BY race"
_HOUR = (
    f"SELECT hour, count(*) AS patient_count, {WAIT} AS avg_wait_min FROM visits WHERE hour IS NOT NULL GROUP BY hour"
)
_MONTH = "SELECT year, month, month_name, count(*) AS patient_count, {wait} FROM visits GROUP BY year, month, month_name"
_PAIRS = "visits WHERE satisfaction_score IS NOT NULL AND wait_time IS NOT NULL"


def _count(keys: str, where: str) -> str:
    return f"SELECT {keys}, count(*) AS count FROM visits WHERE {where} GROUP BY {keys}"


def _department(measure: str) -> str:
    return f"SELECT department_referral, {measure} FROM visits WHERE department_referral IS NOT NULL GROUP BY 1"


def _histogram(column: str, bins: int, by: str = "") -> str:
    return f""", frame AS (
      SELECT floor(min({column})) AS lo, ceil((max({column}) - floor(min({column})) + 1) / {bins}) AS w FROM visits
    )
    SELECT {by} CAST(lo + floor(({column} - lo) / w) * w AS BIGINT) AS bin_start, count(*) AS count
    FROM visits, frame WHERE {column} IS NOT NULL GROUP BY {by} bin_start"""


def _density() -> str:
    return """, scored AS (
      SELECT age_group, satisfaction_score AS s FROM visits WHERE age_group IS NOT NULL AND s IS NOT NULL
    ), shape AS (
      SELECT age_group, count(*) AS size, min(s) AS lo, max(s) AS hi,
             greatest(1.059 * least(stddev_samp(s), (quantile_cont(s, 0.75) - quantile_cont(s, 0.25)) / 1.349)
                      * pow(count(*), -0.2), (max(s) - min(s)) / 100) AS h
      FROM scored GROUP BY age_group
    ), grid AS (
      SELECT *, lo - 4 * h + (hi - lo + 8 * h) * point / 100.0 AS x FROM shape, (SELECT CAST(range AS INT) AS point FROM range(101))
    ), weights AS (SELECT age_group, s, count(*) AS n FROM scored GROUP BY age_group, s)
    SELECT g.age_group, point, round(x, 4) AS satisfaction_score,
           round(sum(n * exp(-0.5 * pow((x - s) / h, 2))) / (size * h * 2.5066282746310002), 4) AS density
    FROM grid g JOIN weights w ON g.age_group = w.age_group GROUP BY g.age_group, point, x, size, h"""


# Two-sided p-value of Student's t in ``tested (t, df)``: the density integrated from 0 to |t| by Simpson's rule.
_P_VALUE = """, steps AS (
  SELECT CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS weight, abs(t) * i / 20000 AS u, df, t
  FROM tested, (SELECT range AS i FROM range(20001))
), tails AS (
  SELECT 1 - 2 * any_value(abs(t)) / 60000 * sum(weight * exp(
    lgamma((df + 1) / 2.0) - lgamma(df / 2.0) - 0.5 * ln(df * pi()) - (df + 1) / 2.0 * ln(1 + u * u / df))) AS p FROM steps
), rounded AS (SELECT round_even(greatest(p, 0) * 10000, 0) / 10000 AS p_value FROM tails)"""
_VERDICT = "CASE WHEN p_value < 0.05 THEN 'significant' WHEN p_value IS NOT NULL THEN 'not significant' END AS verdict"

_T_TEST = """, s AS (
      SELECT count(wait_time) FILTER (is_admitted) AS n1, count(wait_time) FILTER (NOT is_admitted) AS n0,
             avg(wait_time) FILTER (is_admitted) AS m1, avg(wait_time) FILTER (NOT is_admitted) AS m0,
             var_samp(wait_time) FILTER (is_admitted) AS v1, var_samp(wait_time) FILTER (NOT is_admitted) AS v0
      FROM visits
    ), tested AS (
      SELECT (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0)) AS t,
             n1 + n0 - 2 AS df FROM s
    )"""

_HEAT = ", ".join(f"avg(wait_time) FILTER (hour = {h}) AS h{h:02d}" for h in range(24))
_WEEKDAYS = "(VALUES ('Monday'), ('Tuesday'), ('Wednesday'), ('Thursday'), ('Friday'), ('Saturday'), ('Sunday'))"
_AGE_GROUPS = (
    "(VALUES ('Child (0-12)'), ('Teen (13-17)'), ('Young Adult (18-35)'), ('Adult (36-50)'), "
    "('Middle Age (51-65)'), ('Senior (65+)'))"
)
_SAMPLE = "ORDER BY md5('42|' || patient_id) LIMIT"

_BODIES: dict[str, str] = {
    # sources and derivations
    "visits_loaded": "SELECT * FROM visits",
    "raw_text_parsed": "SELECT patient_id, admission_date, admission_time, hour, year, month FROM visits",
    "sql_table": "SELECT department_referral, count(*) FILTER (is_admitted) AS admitted, "
                 "count(*) FILTER (has_referral) AS referred FROM visits GROUP BY department_referral",
    "dept_summary": f"SELECT department_referral AS department, count(*) AS total_patients, {RATE}, "
                    f"{WAIT} AS avg_wait_min, {SCORE} AS avg_satisfaction FROM visits GROUP BY 1",
    "daily_volume": f"SELECT admission_date, count(*) AS patient_count, {WAIT} AS avg_wait_min FROM visits GROUP BY 1",
    # filters
    "selected_visits": "SELECT patient_id, year, gender, department_referral, admission_flag FROM visits "
                       "WHERE year IN (1996, 1997, 1999) AND gender IN ('Female', 'Male') "
                       "AND department_referral IN ('BUILDING', 'None') AND is_admitted",
    "not_admitted_visits": "SELECT patient_id, admission_flag FROM visits WHERE NOT is_admitted",
    "filter_choices": " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS filter, CAST({c} AS VARCHAR) AS value FROM visits WHERE {c} IS NOT NULL"
        for c in ("year", "gender", "department_referral")
    ),
    "long_wait_admitted": "SELECT patient_id, wait_time FROM visits WHERE wait_time > 50 AND is_admitted",
    "low_scores": "SELECT patient_id, satisfaction_score FROM visits WHERE satisfaction_score <= 3",
    "visits_with_hour": "SELECT patient_id, hour FROM visits WHERE hour IS NOT NULL",
    "scored_visits": "SELECT patient_id, satisfaction_score FROM visits WHERE satisfaction_score IS NOT NULL",
    "complete_visits": f"SELECT patient_id, satisfaction_score, wait_time FROM {_PAIRS}",
    "search_visits": f"SELECT {_BROWSE} FROM visits WHERE regexp_matches(patient_id, 'p0+1[0-9]*7$', 'i') "
                     "OR regexp_matches(patient_name, 'p0+1[0-9]*7$', 'i') "
                     "OR regexp_matches(patient_name, '#0+42$', 'i')",
    "search_literal": "SELECT patient_id, patient_name FROM visits "
                      "WHERE contains(lower(patient_id), '0042') OR contains(lower(patient_name), '0042')",
    # SQL reports
    "volume_summary": f"SELECT count(*) AS total_patients, {RATE}, {WAIT} AS avg_wait_min, "
                      f"{SCORE} AS avg_satisfaction_score FROM visits",
    "department_performance": f"SELECT department_referral AS department, count(*) AS patient_count, {RATE}, "
                              f"{WAIT} AS avg_wait_min, {SCORE} AS avg_satisfaction FROM visits GROUP BY 1",
    "equity_by_race": f"SELECT race, count(*) AS total, {RATE}, {WAIT} AS avg_wait_min, {SCORE} AS avg_satisfaction "
                      "FROM visits GROUP BY race",
    "by_gender": f"SELECT gender, count(*) AS patient_count, {RATE}, {WAIT} AS avg_wait_min, "
                 f"{SCORE} AS avg_satisfaction FROM visits GROUP BY gender",
    "by_age_group": f"SELECT age_group, count(*) AS patient_count, round(avg(age), 1) AS avg_age, {RATE}, "
                    f"{WAIT} AS avg_wait_min FROM visits GROUP BY age_group",
    "hourly": f"SELECT hour, count(*) AS patient_count, {RATE}, {WAIT} AS avg_wait_min FROM visits "
              "WHERE hour IS NOT NULL GROUP BY hour",
    "hourly_with_unknown": f"SELECT hour, count(*) AS patient_count, {WAIT} AS avg_wait_min FROM visits GROUP BY hour",
    "by_weekday": f"SELECT day_of_week, count(*) AS patient_count, {WAIT} AS avg_wait_min, "
                  f"{SCORE} AS avg_satisfaction FROM visits GROUP BY day_of_week",
    "monthly_trend": _MONTH.format(wait=f"{WAIT} AS avg_wait_min"),
    "long_wait_alerts": f"SELECT {_ALERT}, admission_date {_ALERT_ROWS} 50",
    "low_score_groups": "SELECT race, gender, age_group, department_referral, count(*) AS count, "
                        f"{SCORE} AS avg_score, {WAIT} AS avg_wait FROM visits WHERE satisfaction_score <= 3 "
                        "GROUP BY ALL ORDER BY count DESC, race NULLS LAST, gender NULLS LAST, age_group NULLS LAST, "
                        "department_referral NULLS LAST LIMIT 20",
    "score_by_wait_bucket": "SELECT CASE WHEN wait_time <= 20 THEN '0–20 min' WHEN wait_time <= 40 THEN '21–40 min' "
                            "WHEN wait_time <= 60 THEN '41–60 min' ELSE '60+ min' END AS wait_bucket, "
                            f"count(*) AS patient_count, {SCORE} AS avg_satisfaction FROM visits "
                            "WHERE satisfaction_score IS NOT NULL GROUP BY 1",
    "yearly": f"SELECT year, count(*) AS total_patients, {RATE}, {WAIT} AS avg_wait_min, "
              f"{SCORE} AS avg_satisfaction FROM visits GROUP BY year",
    "preset_volume_summary": f"SELECT count(*) AS total_patients, {RATE}, {WAIT} AS avg_wait_min, "
                             f"{SCORE} AS avg_satisfaction FROM visits",
    "preset_department_performance": f"SELECT department_referral AS department, count(*) AS patient_count, "
                                     f"{WAIT} AS avg_wait_min, {SCORE} AS avg_satisfaction, {RATE} "
                                     "FROM visits GROUP BY 1",
    "preset_admission_rate_by_race": _RACE,
    "preset_hourly_peak": _HOUR,
    "preset_monthly_trend": _MONTH.format(wait=f"{WAIT} AS avg_wait"),
    "preset_long_wait_admitted": f"SELECT {_ALERT} {_ALERT_ROWS} 20",
    "report_top_departments": f"SELECT department_referral AS department, count(*) AS patient_count, "
                              f"{WAIT} AS avg_wait_min, {SCORE} AS avg_satisfaction FROM visits GROUP BY 1",
    "report_admission_rate_by_race": _RACE,
    "report_hourly_peak": _HOUR,
    "report_long_wait_admitted": f"SELECT {_ALERT} {_ALERT_ROWS} 20",
    "report_monthly_trend": _MONTH.format(wait=f"{WAIT} AS avg_wait"),
    "report_low_scorers": f"SELECT race, gender, age_group, count(*) AS count, {SCORE} AS avg_score FROM visits "
                          "WHERE satisfaction_score <= 3 GROUP BY ALL ORDER BY count DESC, race NULLS LAST, "
                          "gender NULLS LAST, age_group NULLS LAST LIMIT 15",
    "sql_text": f"SELECT time_of_day, count(*) AS visits, count(*) FILTER (is_admitted) AS admitted, "
                f"{WAIT} AS avg_wait FROM visits GROUP BY time_of_day",
    # headline numbers and grouped measures
    "kpi_row": "SELECT count(*) AS total_patients, avg(CAST(is_admitted AS INT)) * 100 AS admission_rate, "
               "avg(wait_time) AS avg_wait_time, avg(satisfaction_score) AS avg_satisfaction, "
               "count(DISTINCT department_referral) AS unique_departments, "
               "strftime(min(admission_date), '%b %d, %Y') AS date_range_start, "
               "strftime(max(admission_date), '%b %d, %Y') AS date_range_end, "
               "count(satisfaction_score) / count(*) * 100 AS pct_with_score, "
               "count(*) FILTER (gender = 'Male') / count(*) * 100 AS pct_male, "
               "count(*) FILTER (gender = 'Female') / count(*) * 100 AS pct_female FROM visits",
    "kpis_of_a_month": "SELECT count(*) AS total_patients, "
                       "count(*) FILTER (is_admitted) * 100.0::DOUBLE / count(is_admitted) AS admission_rate, "
                       "avg(wait_time) AS avg_wait_time, avg(satisfaction_score) AS avg_satisfaction, "
                       "count(DISTINCT department_referral) AS unique_departments, "
                       "strftime(min(admission_date), '%b %d, %Y') AS date_range_start, "
                       "strftime(max(admission_date), '%b %d, %Y') AS date_range_end, "
                       "count(satisfaction_score) * 100.0::DOUBLE / count(*) AS pct_with_score, "
                       "count(*) FILTER (gender = 'Male') * 100.0::DOUBLE / count(*) AS pct_male, "
                       "count(*) FILTER (gender = 'Female') * 100.0::DOUBLE / count(*) AS pct_female FROM visits "
                       "WHERE admission_date BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'",
    "overall_admission_rate": "SELECT avg(CAST(is_admitted AS INT)) * 100 AS overall_rate FROM visits",
    "admission_rates": _long(
        ("gender", "race", "age_group", "department_referral"),
        f"{even('avg(CAST(is_admitted AS INT)) * 100')} AS admission_rate",
    ),
    "mean_waits": _long(
        ("day_of_week", "time_of_day", "department_referral"), f"{even('avg(wait_time)')} AS avg_wait"
    ),
    "score_summary": "SELECT count(satisfaction_score) AS n_scored, "
                     "count(satisfaction_score) * 100.0 / count(*) AS pct_scored, "
                     "round(avg(satisfaction_score), 4) AS mean, round(stddev_samp(satisfaction_score), 4) AS std "
                     "FROM visits",
    "mean_scores": _long(
        ("gender", "race", "age_group", "admission_flag"), f"{even('avg(satisfaction_score)')} AS avg_score",
        "satisfaction_score IS NOT NULL",
    ),
    "frequencies": _long(("gender", "race", "department_referral", "time_of_day"), "count(*) AS n"),
    "age_group_frequencies": f"SELECT g.age_group, count(v.patient_id) AS n FROM {_AGE_GROUPS} AS g(age_group) "
                             "LEFT JOIN visits v ON v.age_group = g.age_group GROUP BY g.age_group",
    "temporal_counts": _long(("year", "month_name", "day_of_week", "hour"), "count(*) AS n"),
    "mean_wait_by_hour": f"SELECT hour, {even('avg(wait_time)')} AS avg_wait FROM visits "
                         "WHERE hour IS NOT NULL GROUP BY hour",
    "yearly_table": "SELECT year, count(patient_id) AS patients, "
                    "printf('%.1f%%', avg(CAST(is_admitted AS INT)) * 100) AS admission_rate, "
                    "printf('%.1f min', avg(wait_time)) AS avg_wait, "
                    "coalesce(printf('%.2f', avg(satisfaction_score)), 'N/A') AS avg_satisfaction "
                    "FROM visits WHERE year IS NOT NULL GROUP BY year",
    "department_table": f"SELECT department_referral AS department, count(patient_id) AS patients, "
                        f"{even('avg(wait_time)')} AS avg_wait, "
                        f"printf('%.1f%%', {even(even('avg(CAST(is_admitted AS INT))') + ' * 100', 1)}) "
                        f"AS admission_rate, {even('avg(satisfaction_score)')} AS avg_score "
                        "FROM visits WHERE department_referral IS NOT NULL GROUP BY 1",
    # statistics
    "wait_summary": "SELECT round(avg(wait_time), 4) AS mean, median(wait_time) AS median, "
                    "round(stddev_samp(wait_time), 4) AS std, min(wait_time) AS min, max(wait_time) AS max, "
                    "quantile_cont(wait_time, 0.25) AS p25, quantile_cont(wait_time, 0.75) AS p75 FROM visits",
    "age_described": " UNION ALL ".join(
        f"SELECT '{name}' AS statistic, {even(expr)} AS value FROM visits"
        for name, expr in {
            "count": "CAST(count(age) AS DOUBLE)", "mean": "avg(age)", "std": "stddev_samp(age)",
            "min": "CAST(min(age) AS DOUBLE)", "25%": "quantile_cont(age, 0.25)", "50%": "quantile_cont(age, 0.5)",
            "75%": "quantile_cont(age, 0.75)", "max": "CAST(max(age) AS DOUBLE)",
        }.items()
    ),
    "wait_t_statistic": """, s AS (
      SELECT count(wait_time) FILTER (is_admitted) AS n1, count(wait_time) FILTER (NOT is_admitted) AS n0,
             avg(wait_time) FILTER (is_admitted) AS m1, avg(wait_time) FILTER (NOT is_admitted) AS m0,
             var_samp(wait_time) FILTER (is_admitted) AS v1, var_samp(wait_time) FILTER (NOT is_admitted) AS v0
      FROM visits
    )
    SELECT round_even((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0 / n1 + 1.0 / n0))
                      * 10000, 0) / 10000 AS t_stat, n1 + n0 - 2 AS df FROM s""",
    "wait_t_test": _T_TEST + _P_VALUE + f"""
      SELECT round_even(t * 10000, 0) / 10000 AS t_stat, df, p_value, {_VERDICT} FROM tested, rounded""",
    "score_wait_correlation": f""", r AS (
      SELECT corr(satisfaction_score, wait_time) AS r, count(*) AS n FROM {_PAIRS}
    ), tested AS (SELECT r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df FROM r){_P_VALUE}
      SELECT n, round_even(r * 10000, 0) / 10000 AS pearson_r, p_value, {_VERDICT} FROM r, rounded""",
    "score_wait_pearson": f"SELECT count(*) AS n, round_even(corr(satisfaction_score, wait_time) * 10000, 0) / 10000 "
                          f"AS pearson_r FROM {_PAIRS}",
    "trend": "SELECT round(regr_slope(satisfaction_score, wait_time), 6) AS slope, "
             "round(regr_intercept(satisfaction_score, wait_time), 4) AS intercept, "
             f"min(wait_time) AS low, max(wait_time) AS high FROM {_PAIRS}",
    "trend_line": f""", line AS (
      SELECT regr_slope(satisfaction_score, wait_time) AS k, regr_intercept(satisfaction_score, wait_time) AS b,
             min(wait_time) AS lo, max(wait_time) AS hi FROM {_PAIRS}
    )
    SELECT CAST(range AS INT) AS point, round(lo + (hi - lo) * range / 99, 4) AS wait_time,
           round(b + k * (lo + (hi - lo) * range / 99), 4) AS score FROM line, range(100)""",
    "wait_bounds": IQR + " SELECT * FROM bounds",
    "anomalies": IQR + " SELECT patient_id, wait_time, anomaly_type FROM outliers",
    "anomaly_summary": IQR + """
      SELECT lower_bound, upper_bound, (SELECT count(*) FROM outliers) AS n_anomalies,
             (SELECT count(*) FROM outliers) * 100.0 / (SELECT count(*) FROM visits) AS pct_anomalies FROM bounds""",
    "anomaly_list": IQR + " SELECT patient_id, gender, age, race, department_referral, wait_time, admission_flag "
                          "FROM outliers ORDER BY patient_id LIMIT 30",
    "anomaly_scatter": IQR + """
      SELECT patient_id, admission_date, wait_time,
             CASE WHEN patient_id IN (SELECT patient_id FROM outliers) THEN 'Anomaly' ELSE 'Normal' END AS status
      FROM visits""",
    "visits_of_anomalous_ids": IQR + " SELECT patient_id, wait_time FROM visits "
                                     "WHERE patient_id IN (SELECT patient_id FROM outliers)",
    "profile": _profile(),
    # charts
    "chart_daily_volume": _count("admission_date", "admission_date IS NOT NULL"),
    "chart_admission_status": _count("admission_flag", "admission_flag IS NOT NULL"),
    "chart_monthly_volume": _count("year, month, month_name", "year IS NOT NULL"),
    "chart_gender": _count("gender", "gender IS NOT NULL"),
    "chart_race": _count("race", "race IS NOT NULL"),
    "chart_age_histogram": _histogram("age", 30),
    "chart_age_box": ", aged AS (SELECT 'all' AS scope, age FROM visits)" + _box("age", "scope", "aged")
                     + _box_rows("age", "scope", ""),
    "chart_age_group_status": _count("age_group, admission_flag", "age_group IS NOT NULL"),
    "chart_department_counts": _department("count(*) AS count"),
    "chart_department_rates": _department("avg(CAST(is_admitted AS INT)) * 100 AS admission_rate"),
    "chart_department_waits": _department("avg(wait_time) AS avg_wait"),
    "chart_wait_histogram": _histogram("wait_time", 40, "admission_flag,"),
    "chart_wait_box": _box("wait_time", "day_of_week") + _box_rows("wait_time", "day_of_week", ""),
    "chart_wait_outliers": _box("wait_time", "day_of_week") + _outlier_rows("wait_time", "day_of_week"),
    "chart_weekday_hour_waits": "SELECT day_of_week, hour, avg(wait_time) AS avg_wait FROM visits "
                                "WHERE day_of_week IS NOT NULL AND hour IS NOT NULL GROUP BY day_of_week, hour",
    "chart_wait_heatmap": f"SELECT d.day_of_week, {_HEAT} FROM {_WEEKDAYS} AS d(day_of_week) "
                          "LEFT JOIN visits v ON v.day_of_week = d.day_of_week GROUP BY d.day_of_week",
    "chart_score_histogram": "SELECT CAST(floor(satisfaction_score) AS BIGINT) AS bin_start, count(*) AS count "
                             "FROM visits WHERE satisfaction_score IS NOT NULL GROUP BY 1",
    "chart_score_by_race": "SELECT race, avg(satisfaction_score) AS avg_score FROM visits WHERE race IS NOT NULL "
                           "GROUP BY race HAVING avg(satisfaction_score) IS NOT NULL",
    "chart_score_wait_points": _count(
        "wait_time, satisfaction_score, admission_flag", "wait_time IS NOT NULL AND satisfaction_score IS NOT NULL"
    ),
    "chart_score_wait_visits": "SELECT patient_id, wait_time, satisfaction_score, admission_flag FROM visits "
                               "WHERE satisfaction_score IS NOT NULL",
    "chart_score_density": _density(),
    "chart_score_box": _box("satisfaction_score", "age_group") + _box_rows("satisfaction_score", "age_group", ""),
    "chart_score_outliers": _box("satisfaction_score", "age_group")
                            + _outlier_rows("satisfaction_score", "age_group"),
    "chart_hourly_volume": _count("hour", "hour IS NOT NULL"),
    "chart_weekday_volume": _count("day_of_week", "day_of_week IS NOT NULL"),
    # model inputs and metrics
    "imputed_features": "SELECT patient_id, " + ", ".join(
        f"CAST(coalesce({c}, (SELECT median({c}) FROM visits)) AS DOUBLE) AS {c}" for c in _NUMBERS
    ) + " FROM visits",
    "label_codes": _codes() + " SELECT feature, label, CAST(code AS INT) AS code FROM codes",
    "feature_matrix": _feature_matrix(),
    "stratified_split": RANKED + " SELECT patient_id, is_admitted, rn <= ceil(0.2 * n) AS is_test FROM ranked",
    "plain_split": RANKED + " SELECT patient_id, rn_all <= ceil(0.2 * n_all) AS is_test FROM ranked",
    "stratified_folds": RANKED + """
      SELECT patient_id, is_admitted, CAST((rn > ceil(round(0.2 * n, 6))) AS INT) + CAST((rn > ceil(round(0.4 * n, 6)))
        AS INT) + CAST((rn > ceil(round(0.6 * n, 6))) AS INT) + CAST((rn > ceil(round(0.8 * n, 6))) AS INT) AS fold
      FROM ranked""",
    "sampled_visits": f"SELECT patient_id, wait_time FROM visits {_SAMPLE} 2000",
    "segment_features": _segment_features(),
    "accuracy": PREDICTED + " SELECT avg(CAST(label = prediction AS INT)) AS accuracy FROM predicted",
    "classification_report": REPORT + """
      SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
      FROM scores
      UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 6), round(sum(hit) / sum(support), 6),
                       round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM scores
      UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                       CAST(sum(support) AS BIGINT) FROM scores
      UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                       CAST(sum(support) AS BIGINT) FROM scores""",
    "class_table": REPORT + """
      SELECT CASE class WHEN '0' THEN 'Not Admitted' ELSE 'Admitted' END AS class,
             round_even(precision * 10000, 0) / 10000 AS precision, round_even(recall * 10000, 0) / 10000 AS recall,
             round_even(f1 * 10000, 0) / 10000 AS f1 FROM scores""",
    "confusion_matrix": PREDICTED + """
      SELECT label, count(*) FILTER (prediction = 0) AS predicted_0, count(*) FILTER (prediction = 1) AS predicted_1
      FROM predicted GROUP BY label""",
    "regression_metrics": """, p AS (
      SELECT satisfaction_score AS y, 10 - coalesce(wait_time, 0) / 10.0 AS p FROM visits
      WHERE satisfaction_score IS NOT NULL
    )
    SELECT round(avg(abs(y - p)), 4) AS mae, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 4) AS r2 FROM p""",
    "cluster_profiles": f"""
      SELECT CAST(is_admitted AS INT) * 2 + CAST(has_referral AS INT) AS cluster, {even('avg(age)')} AS age,
             {even('avg(wait_time)')} AS wait_time, {even('avg(satisfaction_score_filled)')}
             AS satisfaction_score_filled, {even('avg(CAST(is_admitted AS INT))')} AS is_admitted,
             {even('avg(CAST(has_referral AS INT))')} AS has_referral, count(*) AS size
      FROM visits GROUP BY cluster""",
    "patient_segments": _lloyd() + f"""
      SELECT cluster, {even('avg(age)')} AS avg_age, {even('avg(wait_time)')} AS avg_wait,
             {even('avg(satisfaction_score_filled)')} AS avg_satisfaction,
             {even('avg(CAST(is_admitted AS INT))')} AS admitted_rate,
             {even('avg(CAST(has_referral AS INT))')} AS referral_rate, count(*) AS size
      FROM clustered GROUP BY cluster""",
    "segment_scatter": _lloyd() + " SELECT patient_id, wait_time, satisfaction_score_filled, cluster FROM clustered "
                                  + _SAMPLE + " 2000",
    # quality
    "quality_summary": _quality(),
    "quarantined_visits": "SELECT patient_id, 'admission_date_present' AS violations FROM visits "
                          "WHERE admission_date IS NULL",
    "duplicate_ids": "SELECT patient_name AS patient_id, count(*) AS n FROM visits WHERE patient_name IS NOT NULL "
                     "GROUP BY patient_name HAVING count(*) > 1",
    "duplicate_order_ids": "SELECT printf('P%09d', l_orderkey) AS patient_id, count(*) AS n FROM lineitem "
                           "GROUP BY l_orderkey HAVING count(*) > 1",
    "departments_filled": "SELECT patient_id, CASE WHEN department_referral = 'HOUSEHOLD' THEN 'None' "
                          "ELSE department_referral END AS department_referral FROM visits",
    "short_time_labels": """SELECT time_of_day, count(*) AS visits FROM (
      SELECT CASE WHEN hour IS NULL THEN 'Unknown' WHEN hour BETWEEN 6 AND 11 THEN 'Morning'
        WHEN hour BETWEEN 12 AND 17 THEN 'Afternoon' WHEN hour BETWEEN 18 AND 23 THEN 'Evening' ELSE 'Night' END
        AS time_of_day FROM visits) GROUP BY time_of_day""",
    "quick_chart_of_departments": "SELECT department_referral AS department, count(*) AS visits FROM visits "
                                  "GROUP BY 1 ORDER BY visits DESC, department LIMIT 3",
    "assigned_segments": _assigned(),
    "assigned_inertia": _assigned("sum(distance) AS inertia, count(*) AS visits"),
    "table_shape": "SELECT count(*) AS n_rows, CAST(23 AS INT) AS n_columns, "
                   "count(*) FILTER (patient_id IS NULL AND age IS NULL) AS empty_rows, "
                   "min(age) AS min_age, max(age) AS max_age FROM visits",
}

_RECURSIVE = VISITS.replace("WITH base", "WITH RECURSIVE base", 1)

ORACLE = {name: (_RECURSIVE if ", steps AS" in body else VISITS) + ("\n" if body.lstrip().startswith(",") else "\n") + body for name, body in _BODIES.items()}
