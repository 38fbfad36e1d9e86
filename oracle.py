"""Independent SQL (DuckDB dialect) for every registered query, over the same Parquet tables.

Written from the definitions, in other forms than the Spark code where there is a choice: row
numbers for the dedup, one query per threshold, self-joins for the local trend, the engine's
own quantiles for the box plot.
"""

from __future__ import annotations

import re

CTES = {
    "activity": """
        SELECT o_orderpriority AS course_run, o_custkey AS learner_id,
               CAST(1 + l_suppkey % 3 AS INTEGER)::VARCHAR || '.' || l_linenumber::VARCHAR AS step,
               CAST(1 + l_suppkey % 3 AS INTEGER) AS week_number,
               CAST(l_linenumber AS INTEGER) AS step_number,
               l_shipdate AS first_visited_at,
               CASE WHEN l_returnflag <> 'R'
                    THEN l_shipdate + to_days(CAST(l_quantity AS INTEGER)) END AS last_completed_at,
               l_returnflag <> 'R' AS step_completed
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "order_dates": """
        SELECT o_custkey, o_orderpriority, min(o_orderdate) AS first_order,
               max(o_orderdate) FILTER (WHERE o_orderstatus = 'F' AND o_totalprice >= 350000) AS finished
        FROM orders GROUP BY ALL""",
    "enrolments": """
        SELECT c_custkey AS learner_id, r.o_orderpriority AS course_run,
               coalesce(first_order, TIMESTAMP '1995-01-01') AS enrolled_at,
               CAST(NULL AS TIMESTAMP) AS unenrolled_at,
               finished AS fully_participated_at,
               CAST(NULL AS TIMESTAMP) AS purchased_statement_at,
               CASE c_nationkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'Unknown' END AS gender,
               n_name AS country,
               CASE WHEN c_custkey % 997 = 0 THEN '>65' WHEN c_acctbal < 0 THEN 'Unknown'
                    WHEN c_acctbal < 2500 THEN '18-25' WHEN c_acctbal < 5000 THEN '26-35'
                    WHEN c_acctbal < 7500 THEN '36-45' ELSE '46-55' END AS age_range,
               CASE c_custkey % 5 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'secondary' WHEN 2 THEN 'bachelor'
                    WHEN 3 THEN 'master' ELSE 'doctorate' END AS highest_education_level,
               CASE c_custkey % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'full_time'
                    WHEN 2 THEN 'part_time' ELSE 'looking' END AS employment_status,
               CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'Unknown' ELSE c_mktsegment END AS employment_area
        FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) r
        LEFT JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN order_dates d ON d.o_custkey = c_custkey AND d.o_orderpriority = r.o_orderpriority""",
    "duplicates": """
        SELECT DISTINCT course_run, learner_id, step, n
        FROM (SELECT *, count(*) OVER (PARTITION BY course_run, learner_id, step) AS n FROM activity)
        WHERE n > 1""",
    "clean": """
        SELECT * FROM activity
        QUALIFY row_number() OVER (
            PARTITION BY course_run, learner_id, step
            ORDER BY coalesce(last_completed_at, first_visited_at) DESC NULLS LAST,
                     last_completed_at DESC NULLS LAST, first_visited_at DESC NULLS LAST) = 1""",
    "course_size": """
        SELECT course_run, count(DISTINCT step) AS total_steps_in_course FROM clean GROUP BY course_run""",
    "week_size": """
        SELECT course_run, count(DISTINCT step) AS week1_total_steps
        FROM clean WHERE week_number = 1 GROUP BY course_run""",
    "engagement": """
        SELECT course_run, learner_id, count(*) AS total_steps_visited,
               count(last_completed_at) AS total_steps_completed,
               min(first_visited_at) AS first_activity,
               max(coalesce(last_completed_at, first_visited_at)) AS last_activity,
               count(DISTINCT coalesce(week_number, -1)) AS num_weeks_active,
               max(week_number) AS max_week_reached,
               count(*) / count(DISTINCT coalesce(week_number, -1)) AS avg_steps_per_week,
               date_diff('microsecond', min(first_visited_at),
                         max(coalesce(last_completed_at, first_visited_at))) / 86400e6
                   AS engagement_duration_days
        FROM clean GROUP BY course_run, learner_id""",
    "summary": """
        SELECT e.learner_id, e.course_run, e.enrolled_at, e.fully_participated_at,
               CASE WHEN gender <> 'Unknown' THEN gender END AS gender,
               CASE WHEN country <> 'Unknown' THEN country END AS country,
               CASE WHEN age_range <> 'Unknown' THEN age_range END AS age_range,
               CASE WHEN highest_education_level <> 'Unknown' THEN highest_education_level END
                   AS highest_education_level,
               CASE WHEN employment_status <> 'Unknown' THEN employment_status END AS employment_status,
               CASE WHEN employment_area <> 'Unknown' THEN employment_area END AS employment_area,
               coalesce(total_steps_visited, 0) AS total_steps_visited,
               coalesce(total_steps_completed, 0) AS total_steps_completed,
               first_activity, last_activity,
               coalesce(num_weeks_active, 0) AS num_weeks_active,
               coalesce(max_week_reached, 0) AS max_week_reached,
               avg_steps_per_week, engagement_duration_days, total_steps_in_course,
               e.fully_participated_at IS NOT NULL AS completed,
               CASE WHEN total_steps_in_course > 0
                    THEN 100 * coalesce(total_steps_completed, 0) / total_steps_in_course END
                   AS completion_percentage
        FROM enrolments e
        LEFT JOIN engagement USING (course_run, learner_id)
        LEFT JOIN course_size USING (course_run)""",
    "active": "SELECT * FROM summary WHERE total_steps_visited > 0",
    "week_activity": """
        SELECT *, coalesce(last_completed_at, first_visited_at) AS last_touch
        FROM clean WHERE week_number = 1""",
    "week_raw": """
        SELECT course_run, learner_id, count(*) AS week1_steps_visited,
               count(last_completed_at) AS week1_steps_completed,
               min(first_visited_at) AS week1_first_visit, max(last_touch) AS week1_last_visit,
               max(step_number) AS week1_max_step
        FROM week_activity GROUP BY course_run, learner_id""",
    "week_metrics": """
        SELECT *,
               CASE WHEN week1_completion_rate >= 75 THEN 'High'
                    WHEN week1_completion_rate >= 40 THEN 'Medium'
                    WHEN week1_completion_rate >= 10 THEN 'Low'
                    WHEN week1_completion_rate >= 0 THEN 'Very Low' END AS week1_engagement_level
        FROM (SELECT w.*, week1_total_steps,
                     CASE WHEN week1_total_steps > 0
                          THEN 100 * week1_steps_completed / week1_total_steps END AS week1_completion_rate,
                     date_diff('microsecond', week1_first_visit, week1_last_visit) / 86400e6
                         AS week1_duration_days
              FROM week_raw w LEFT JOIN week_size USING (course_run))""",
    "learners": """
        SELECT s.*, coalesce(week1_steps_visited, 0) AS week1_steps_visited,
               coalesce(week1_steps_completed, 0) AS week1_steps_completed,
               week1_first_visit, week1_last_visit, week1_max_step, week1_total_steps,
               coalesce(week1_completion_rate, 0) AS week1_completion_rate, week1_duration_days,
               coalesce(week1_engagement_level, 'None') AS week1_engagement_level,
               CAST(CASE week1_engagement_level WHEN 'High' THEN 4 WHEN 'Medium' THEN 3 WHEN 'Low' THEN 2
                    WHEN 'Very Low' THEN 1 ELSE 0 END AS INTEGER) AS week1_level_rank
        FROM summary s LEFT JOIN week_metrics m USING (course_run, learner_id)""",
    "week_active": "SELECT * FROM learners WHERE week1_steps_visited > 0",
    "overall": """
        SELECT count(*) AS n_enrolled, count(*) FILTER (WHERE total_steps_visited > 0) AS n_active,
               count(fully_participated_at) AS n_completed,
               count(fully_participated_at) / count(*) AS completion_rate
        FROM summary""",
    "by_completion": """
        SELECT completed, count(*) AS n, avg(total_steps_completed) AS mean_steps_completed,
               median(total_steps_completed) AS median_steps_completed,
               avg(num_weeks_active) AS mean_weeks_active
        FROM active GROUP BY completed""",
    "week_by_completion": """
        SELECT completed, count(*) AS n, avg(week1_steps_completed) AS mean_week1_steps_completed,
               median(week1_steps_completed) AS median_week1_steps_completed,
               avg(week1_completion_rate) AS mean_week1_completion_rate
        FROM week_active GROUP BY completed""",
    "by_level": """
        SELECT week1_engagement_level, week1_level_rank, count(*) AS n,
               avg(completed::INTEGER) AS completion_rate
        FROM week_active GROUP BY ALL""",
    "level_counts": """
        SELECT week1_engagement_level, week1_level_rank, count(*) AS n,
               count(*) / (SELECT count(*) FROM learners) * 100 AS percentage
        FROM learners GROUP BY ALL""",
    "long": """
        SELECT course_run, learner_id, completed, 'Steps Completed' AS metric,
               total_steps_completed::DOUBLE AS value FROM active
        UNION ALL
        SELECT course_run, learner_id, completed, 'Weeks Active', num_weeks_active::DOUBLE FROM active
        UNION ALL
        SELECT course_run, learner_id, completed, 'Duration (Days)', engagement_duration_days FROM active""",
    "rates_long": """
        SELECT course_run, learner_id, completed, 'Week 1 Only' AS period,
               week1_completion_rate AS completion_pct FROM week_active
        UNION ALL
        SELECT course_run, learner_id, completed, 'Overall Course', completion_percentage FROM week_active""",
    "box": """
        SELECT metric, completed, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
               quantile_cont(value, 0.75) AS q3
        FROM long WHERE value IS NOT NULL GROUP BY metric, completed""",
    "fenced": """
        SELECT l.*, q1, median, q3,
               value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS outside
        FROM long l JOIN box USING (metric, completed) WHERE value IS NOT NULL""",
    "step_points": """
        SELECT week1_steps_completed, count(*) AS n, avg(completed::INTEGER) * 100 AS completion_rate
        FROM week_active GROUP BY week1_steps_completed HAVING count(*) >= 10""",
    "cycle1": """
        SELECT CASE WHEN completed THEN 'Completed' ELSE 'Did Not Complete' END AS status, n,
               round(mean_steps_completed, 1) AS steps_mean, median_steps_completed AS steps_median,
               round(mean_weeks_active, 1) AS weeks_mean
        FROM by_completion""",
}


def _with(body: str) -> str:
    """Prefix the common table expressions a query needs, in order of definition."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in needed and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    parts = [f"{name} AS ({CTES[name]})" for name in CTES if name in needed]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def _pct(value: str) -> str:
    return rf"(regexp_replace(printf('%.1f', round({value}, 1)), '\.0$', '') || '%')"


def _common(name: str) -> str:
    """A column as text, with as many decimals, two at most, as its longest number needs."""
    needs = f"CASE WHEN {name} IS NULL THEN 0 ELSE length(rtrim(split_part(format('{{:.2f}}', round({name}, 2)), '.', 2), '0')) END"
    forms = " ".join(f"WHEN {d} THEN format('{{:,.{d}f}}', round({name}, 2))" for d in range(3))
    return f"CASE max({needs}) OVER () {forms} END AS {name}"


def _comma(n: str) -> str:
    return f"format('{{:,}}', {n})"


def _histogram(source: str, value: str, by: str, bins: int) -> str:
    """Bin rows of ``source``; the bin list is crossed with the groups and counted by a join."""
    return f"""
        SELECT {by}, bin, origin + bin * width AS bin_start,
               origin + bin * width + width AS bin_end, count(v) AS n
        FROM (SELECT *, CAST(unnest(range(0, last_bin + 1)) AS INTEGER) AS bin FROM grid)
        LEFT JOIN (
            SELECT {by}, {value} AS v,
                   CAST(greatest(ceil(({value} - origin) / width - 1e-8) - 1, 0) AS INTEGER) AS bin
            FROM {source}, (SELECT any_value(origin) AS origin, any_value(width) AS width FROM grid)
            WHERE {value} IS NOT NULL) USING ({by}, bin)
        GROUP BY ALL"""


def _grid(source: str, value: str, by: str, bins: int) -> str:
    return f"""
        SELECT DISTINCT {by}, width, origin,
               CAST(greatest(ceil((hi - origin) / width - 1e-8) - 1, 0) AS INTEGER) AS last_bin
        FROM (SELECT {by} FROM {source} WHERE {value} IS NOT NULL),
             (SELECT *, floor((lo - width / 2) / width) * width + width / 2 AS origin
              FROM (SELECT lo, hi, CASE WHEN hi > lo THEN (hi - lo) / {bins - 1} ELSE 0.1 END AS width
                    FROM (SELECT min({value})::DOUBLE AS lo, max({value})::DOUBLE AS hi FROM {source})))"""


def _binned(source: str, value: str, by: str, bins: int, outer: str = "SELECT * FROM histogram") -> str:
    body = _with(f"SELECT 1 FROM {source}").removesuffix(f"SELECT 1 FROM {source}").rstrip()
    return (
        f"{body}, grid AS ({_grid(source, value, by, bins)}), "
        f"histogram AS ({_histogram(source, value, by, bins)}) {outer}"
    )


_STEPS_HISTOGRAM = ("active", "total_steps_completed", "completed", 50)

_RETENTION = """
    SELECT {run} week_number, active_learners,
           active_learners / first_value(active_learners) OVER ({part} ORDER BY week_number NULLS LAST) * 100
               AS retention_rate
    FROM (SELECT {run} week_number, count(DISTINCT learner_id) AS active_learners
          FROM clean GROUP BY ALL)"""

_THRESHOLDS = " UNION ALL ".join(
    f"""SELECT {t}::DOUBLE AS threshold, count(*) AS n, avg(completed::INTEGER) * 100 AS completion_rate,
               (SELECT avg(completed::INTEGER) * 100 FROM week_active) AS overall_rate
        FROM week_active WHERE week1_completion_rate >= {t}"""
    for t in range(0, 101, 10)
)

_DEMOGRAPHICS = (
    "gender", "country", "age_range", "highest_education_level", "employment_status", "employment_area",
)

_TREND = """
    SELECT week1_steps_completed, n, completion_rate,
           round(CASE WHEN used >= 3 AND det <> 0 THEN num / det END, 6) AS trend
    FROM (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det,
                 t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2) AS num
          FROM (SELECT week1_steps_completed, n, completion_rate, count(*) FILTER (WHERE w > 0) AS used,
                       sum(w) AS s0, sum(w * u) AS s1, sum(w * u ** 2) AS s2, sum(w * u ** 3) AS s3,
                       sum(w * u ** 4) AS s4, sum(w * y) AS t0, sum(w * y * u) AS t1,
                       sum(w * y * u ** 2) AS t2
                FROM (SELECT *, CASE WHEN abs(u) < 1 THEN (1 - abs(u) ** 3) ** 3 ELSE 0 END AS w
                      FROM (SELECT a.*, b.completion_rate AS y,
                                   (b.week1_steps_completed - a.week1_steps_completed) / a.reach AS u
                            FROM (SELECT p.*, nth.reach
                                  FROM step_points p JOIN (
                                      SELECT x, d AS reach
                                      FROM (SELECT c.week1_steps_completed AS x,
                                                   abs(o.week1_steps_completed - c.week1_steps_completed) AS d
                                            FROM step_points c, step_points o)
                                      QUALIFY row_number() OVER (PARTITION BY x ORDER BY d)
                                          = floor(0.75 * count(*) OVER (PARTITION BY x))
                                  ) nth ON nth.x = p.week1_steps_completed) a, step_points b))
                GROUP BY ALL))"""

#: Fits at the ends of the cells, by all points against all ends, and cubics between them at 80 positions.
_DRAWN = """
    SELECT round(x, 6) AS week1_steps_completed, round(trend, 6) AS trend FROM (
        WITH RECURSIVE pts AS (
            SELECT week1_steps_completed::DOUBLE AS x, completion_rate AS y,
                   row_number() OVER (ORDER BY week1_steps_completed) - 1 AS r
            FROM step_points
        ), extent AS (
            SELECT count(*) AS n, greatest(floor(count(*) * 0.75::DOUBLE * 0.2::DOUBLE), 1) AS most,
                   floor(count(*) * 0.75::DOUBLE)::BIGINT AS q, min(x) AS low, max(x) AS high,
                   0.005::DOUBLE * greatest(max(x) - min(x), greatest(abs(min(x)), abs(max(x))) * 1e-3 + 1e-30) AS margin
            FROM pts
        ), cells AS (
            SELECT 0::BIGINT AS a, n - 1 AS b FROM extent WHERE n > 0
            UNION ALL
            SELECT if(part = 0, a, (a + b) // 2 + 1), if(part = 0, (a + b) // 2, b)
            FROM cells, extent, (VALUES (0), (1)) parts(part) WHERE b - a + 1 > most
        ), ends AS (
            SELECT low - margin AS c FROM extent WHERE n > 0 UNION ALL SELECT high + margin FROM extent WHERE n > 0
            UNION ALL
            SELECT (p.x + o.x) / 2
            FROM cells JOIN pts p ON p.r = b JOIN pts o ON o.r = b + 1, extent WHERE b - a + 1 <= most
        ), reached AS (
            SELECT c, list_sort(list(abs(x - c)))[any_value(q)] AS reach FROM ends, pts, extent GROUP BY c
        ), sums AS (
            SELECT c, reach, count(*) FILTER (WHERE w > 0) AS used, sum(w) AS s0, sum(w * u) AS s1,
                   sum(w * u ** 2) AS s2, sum(w * u ** 3) AS s3, sum(w * u ** 4) AS s4,
                   sum(w * y) AS t0, sum(w * y * u) AS t1, sum(w * y * u ** 2) AS t2
            FROM (SELECT *, CASE WHEN abs(u) < 1 THEN (1 - abs(u) ** 3) ** 3 ELSE 0 END AS w
                  FROM (SELECT c, reach, y, (x - c) / reach AS u FROM reached, pts WHERE reach > 0))
            GROUP BY c, reach
        ), fits AS (
            SELECT c, CASE WHEN used >= 3 AND det <> 0
                      THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / det END AS v,
                   CASE WHEN used >= 3 AND det <> 0
                   THEN (s0 * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det / reach END AS d
            FROM (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM sums)
        ), spans AS (
            SELECT c AS c0, v AS v0, d AS d0, lead(c) OVER by_c AS c1, lead(v) OVER by_c AS v1, lead(d) OVER by_c AS d1
            FROM ends LEFT JOIN fits USING (c) WINDOW by_c AS (ORDER BY c)
        )
        SELECT x, (1 - t) ** 2 * (1 + 2 * t) * v0 + t ** 2 * (3 - 2 * t) * v1
                  + (c1 - c0) * (t * (1 - t) ** 2 * d0 - t ** 2 * (1 - t) * d1) AS trend
        FROM (SELECT *, (x - c0) / (c1 - c0) AS t
              FROM (SELECT low + i * ((high - low) / 79) AS x FROM extent, range(80) positions(i) WHERE n > 0)
              JOIN spans ON x >= c0 AND x < c1))"""

ORACLE = {
    "step_activity_all": _with("SELECT * FROM activity"),
    "enrolments_all": _with("SELECT * FROM enrolments"),
    "parse_utc": _with(
        """SELECT course_run, learner_id, step,
                  CASE WHEN step_number <= 2 THEN strftime(first_visited_at, '%Y-%m-%d %H:%M:%S') || ' UTC'
                       WHEN step_number <= 4 THEN strftime(first_visited_at, '%Y-%m-%d %H:%M:%S')
                       WHEN step_number = 5 THEN ''
                       WHEN step_number = 6 THEN strftime(first_visited_at, '%Y-%m-%d')
                       ELSE 'at ' || strftime(first_visited_at, '%Y-%m-%d %H:%M:%S') END AS visit_text,
                  CASE WHEN step_number <= 4 THEN date_trunc('second', first_visited_at) END AS visited_at
           FROM activity"""
    ),
    "inactive_summary": _with(
        """SELECT e AS enrolled_learners, a AS active_learners, e - a AS never_active
           FROM (SELECT count(*) AS e FROM (SELECT DISTINCT learner_id FROM enrolments)),
                (SELECT count(*) AS a FROM (SELECT DISTINCT learner_id FROM activity))"""
    ),
    "dup_groups_step_activity": _with("SELECT * FROM duplicates"),
    "step_activity_clean": _with("SELECT * FROM clean"),
    "step_activity_clean_any_week": _with("SELECT * FROM clean"),
    "steps_per_run": _with("SELECT * FROM course_size"),
    "learner_engagement": _with("SELECT * FROM engagement"),
    "learner_summary": _with("SELECT * FROM summary"),
    "learner_summary_active": _with("SELECT * FROM active"),
    "completion_overall": _with("SELECT * FROM overall"),
    "engagement_by_completion": _with("SELECT * FROM by_completion"),
    "median_steps_by_completion": _with(
        "SELECT completed, quantile_cont(total_steps_completed, 0.5) AS median_steps FROM active GROUP BY completed"
    ),
    "missing_demographics": _with(
        " UNION ALL ".join(
            f"SELECT '{d}' AS demographic, count(*) - count({d}) AS n_missing FROM summary" for d in _DEMOGRAPHICS
        )
    ),
    "completed_by_steps": _with(
        """SELECT count(*) AS n_enrolled, count(*) FILTER (WHERE completion_percentage >= 80) AS n_completed,
                  count(*) FILTER (WHERE completion_percentage >= 80) / count(*) AS completion_rate
           FROM summary"""
    ),
    **{
        f"completion_by_demographic_{d}": _with(
            f"""SELECT {d} AS demographic, count(*) AS n, avg(completed::INTEGER) * 100 AS completion_rate
                FROM summary WHERE {d} IS NOT NULL GROUP BY {d} HAVING count(*) >= 30"""
        )
        for d in _DEMOGRAPHICS
    },
    "week1_activity": _with("SELECT * FROM week_activity"),
    "week1_steps_per_run": _with("SELECT * FROM week_size"),
    "week1_metrics": _with("SELECT * FROM week_metrics"),
    "week1_metrics_any_week": _with("SELECT * FROM week_metrics"),
    "learner_with_week1": _with("SELECT * FROM learners"),
    "learner_with_week1_any_week": _with("SELECT * FROM learners"),
    "learner_with_week1_active": _with("SELECT * FROM week_active"),
    "week1_summary": _with(
        """SELECT count(*) AS n_enrolled, count(*) FILTER (WHERE week1_steps_visited > 0) AS n_week1_active,
                  count(*) FILTER (WHERE week1_steps_visited > 0) / count(*) AS prop_week1_active
           FROM learners"""
    ),
    "week1_by_completion": _with(
        """SELECT * REPLACE (round(mean_week1_completion_rate, 6) AS mean_week1_completion_rate)
           FROM week_by_completion"""
    ),
    "completion_by_week1_level": _with("SELECT * FROM by_level"),
    "completion_by_week1_level_by_run": _with(
        """SELECT course_run, week1_engagement_level, week1_level_rank, count(*) AS n,
                  avg(completed::INTEGER) AS completion_rate
           FROM week_active GROUP BY ALL"""
    ),
    "completion_by_week1_level_pct": _with(
        """SELECT week1_engagement_level, week1_level_rank, count(*) AS n,
                  count(fully_participated_at) AS n_completed, avg(completed::INTEGER) * 100 AS completion_rate
           FROM week_active GROUP BY ALL"""
    ),
    "completion_by_week1_steps": _with("SELECT * FROM step_points"),
    "at_risk_learners": _with(
        """SELECT course_run, learner_id, week1_completion_rate, week1_engagement_level
           FROM learners WHERE week1_engagement_level IN ('Low', 'Very Low')"""
    ),
    "completion_funnel": _with(
        f"""SELECT stage, stage_rank, count, percentage,
                   {_comma('count')} || chr(10) || '(' || {_pct('percentage')} || ')' AS label
            FROM (SELECT 'Enrolled' AS stage, 1 AS stage_rank, n_enrolled AS count,
                         n_enrolled / n_enrolled * 100 AS percentage FROM overall
                  UNION ALL SELECT 'Active', 2, n_active, n_active / n_enrolled * 100 FROM overall
                  UNION ALL SELECT 'Completed', 3, n_completed, n_completed / n_enrolled * 100 FROM overall)"""
    ),
    "weekly_retention": _with(_RETENTION.format(run="", part="")),
    "weekly_retention_by_run": _with(_RETENTION.format(run="course_run,", part="PARTITION BY course_run")),
    "week1_level_distribution": _with(
        f"""SELECT *, CASE WHEN percentage >= 8
                      THEN {_comma('n')} || chr(10) || '(' || {_pct('percentage')} || ')' END AS label
            FROM level_counts"""
    ),
    "engagement_long": _with("SELECT * FROM long"),
    "week1_vs_overall_long": _with("SELECT * FROM rates_long"),
    "steps_histogram": _binned(*_STEPS_HISTOGRAM),
    "steps_histogram_peak": _binned(*_STEPS_HISTOGRAM, outer="SELECT max(n) AS y_max FROM histogram"),
    "duration_histogram": _binned("active", "engagement_duration_days", "completed", 50),
    "week1_vs_overall_histogram": _binned("rates_long", "completion_pct", "period, completed", 30),
    "engagement_boxplot": _with(
        """SELECT metric, completed, count(*) AS n,
                  round(least(min(value) FILTER (WHERE NOT outside), q1), 6) AS lower_whisker,
                  round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
                  round(greatest(max(value) FILTER (WHERE NOT outside), q3), 6) AS upper_whisker,
                  count(*) FILTER (WHERE outside) AS n_outliers
           FROM fenced GROUP BY metric, completed, fenced.q1, fenced.median, fenced.q3"""
    ),
    "engagement_outliers": _with(
        "SELECT course_run, learner_id, completed, metric, value FROM fenced WHERE outside"
    ),
    "threshold_curve": _with(_THRESHOLDS),
    "week1_steps_trend": _with(_TREND),
    "week1_steps_trend_drawn": _with(_DRAWN),
    "enrollment_summary": _with(
        f"""SELECT 'Total Enrollments' AS metric, {_comma('n_enrolled')} AS value FROM overall
            UNION ALL SELECT 'Active Learners (≥1 step)', {_comma('n_active')} FROM overall
            UNION ALL SELECT 'Learners Who Completed', {_comma('n_completed')} FROM overall
            UNION ALL SELECT 'Activation Rate', {_pct('n_active / n_enrolled * 100')} FROM overall
            UNION ALL SELECT 'Completion Rate (all enrolled)', {_pct('completion_rate * 100')} FROM overall
            UNION ALL SELECT 'Completion Rate (active only)', {_pct('avg(completed::INTEGER) * 100')}
            FROM active"""
    ),
    "engagement_table": _with(
        """SELECT CASE WHEN completed THEN 'Completed' ELSE 'Did Not Complete' END AS status, n,
                  round(mean_steps_completed, 1) AS mean_steps, round(median_steps_completed, 1) AS median_steps,
                  round(mean_weeks_active, 1) AS mean_weeks
           FROM by_completion"""
    ),
    "cycle1_summary": _with("SELECT * FROM cycle1"),
    "effect_sizes": _with(
        """SELECT round(c.steps_mean / nullif(o.steps_mean, 0), 1) AS steps_ratio,
                  round(c.weeks_mean / nullif(o.weeks_mean, 0), 1) AS weeks_ratio
           FROM (SELECT * FROM cycle1 WHERE status = 'Completed') c,
                (SELECT * FROM cycle1 WHERE status = 'Did Not Complete') o"""
    ),
    "week1_dist_table": _with(
        f"""SELECT week1_engagement_level, n, {_pct('percentage')} AS percent_of_all_learners FROM level_counts"""
    ),
    "week1_comp_table": _with(
        """SELECT CASE WHEN completed THEN 'Completed' ELSE 'Did Not Complete' END AS status, n,
                  round(mean_week1_steps_completed, 1) AS mean_week1_steps,
                  round(mean_week1_completion_rate, 1) AS mean_week1_rate
           FROM week_by_completion"""
    ),
    "comp_by_level_table": _with(
        f"""SELECT week1_engagement_level, n, {_pct('completion_rate * 100')} AS completion_rate FROM by_level"""
    ),
    "week1_lift": _with(
        """SELECT round(h * 100, 1) AS high_percent, round(v * 100, 1) AS very_low_percent,
                  round(h / nullif(v, 0), 1) AS lift
           FROM (SELECT max(completion_rate) FILTER (WHERE week1_engagement_level = 'High') AS h,
                        max(completion_rate) FILTER (WHERE week1_engagement_level = 'Very Low') AS v
                 FROM by_level)"""
    ),
    "activation_gap": _with(
        "SELECT round((1 - n_active / n_enrolled) * 100, 1) AS activation_gap_percent FROM overall"
    ),
    "week1_high_share": _with(
        """SELECT round(count(*) FILTER (WHERE week1_engagement_level = 'High') / count(*) * 100, 1)
                      AS high_share_percent
           FROM learners"""
    ),
    "mean_course_size": _with(
        """SELECT round(avg(total_steps_in_course)) AS mean_total_steps,
                  (SELECT round(avg(week1_total_steps)) FROM week_size) AS mean_week1_steps,
                  (SELECT round(avg(week1_total_steps)) FROM week_size) * 0.5::DOUBLE AS half_week1_steps
           FROM course_size"""
    ),
    "dataset_dimensions": _with(
        """SELECT (SELECT count(*) FROM enrolments) AS enrolment_rows, 12::INTEGER AS enrolment_columns,
                  (SELECT count(*) FROM activity) AS activity_rows, 8::INTEGER AS activity_columns,
                  (SELECT count(*) FROM duplicates) AS duplicate_groups"""
    ),
    "format_summary_table": _with(
        f"""SELECT completed, {_comma('n')} AS n, {_common('mean_steps_completed')}, {_common('median_steps_completed')},
                   {_common('mean_weeks_active')}
            FROM by_completion"""
    ),
}
_PADDED = ", ".join(
    f"lpad({c}, max(length({c})) OVER ()::INTEGER, ' ') AS {c}"
    for c in ("n", "mean_steps_completed", "median_steps_completed", "mean_weeks_active")
)
ORACLE["format_summary_table_padded"] = f"SELECT completed, {_PADDED} FROM ({ORACLE['format_summary_table']})"
#: The same results by other ways.
ORACLE |= {f"{name}_merged": ORACLE[name] for name in ("inactive_summary", "weekly_retention", "weekly_retention_by_run")}
