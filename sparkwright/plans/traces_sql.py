"""The trace queries over the stand-in bundle as SQL of DuckDB, written independently of the plans."""

from __future__ import annotations

from sparkwright.functions.stats import poisson_steps
from sparkwright.plans.bundle import STAND_IN_SQL

U = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
CANON = """canon AS (SELECT a.task_id, a.model_id, arg_max(struct_pack(answer_id := a.answer_id, trace_id := a.trace_id, correct := a.correct, duration_ms := t.duration_ms, cost := t.cost, status := t.status), (t.attempt_number, t.end_us, a.answer_id)) AS b
  FROM answers a JOIN traces t USING (trace_id) GROUP BY 1, 2)"""
BINOM = "CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least({b}, {c}) + 1), lambda k: exp(lgamma({b} + {c} + 1) - lgamma(k + 1) - lgamma({b} + {c} - k + 1) - ({b} + {c}) * ln(2))))) END"
CORR = "CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN (avg({x} * {y}) - avg({x}) * avg({y})) / (stddev_pop({x}) * stddev_pop({y})) END"

ISSUES = """prior AS (SELECT annotation_id AS pid, target_type AS p_type, target_id AS p_target, annotator_id AS p_annotator, schema_version AS p_schema, labeled_us AS p_us FROM annotations QUALIFY row_number() OVER (PARTITION BY annotation_id) = 1),
x AS (SELECT a.*, count(*) OVER (PARTITION BY a.annotation_id) AS copies, EXISTS (SELECT 1 FROM traces t WHERE t.trace_id = a.target_id) AS there, p.* FROM annotations a LEFT JOIN prior p ON a.supersedes = p.pid),
reasons AS (SELECT annotation_id, unnest(list_filter([CASE WHEN copies > 1 THEN 'duplicate_annotation_id' END, CASE WHEN NOT there THEN 'missing_trace_target' END, CASE WHEN trace_id <> target_id THEN 'trace_target_mismatch' END, CASE WHEN annotator_id IS NULL THEN 'missing_annotator_id' END,
  CASE WHEN ingested_us < labeled_us THEN 'ingested_before_labeled' END, CASE WHEN supersedes IS NOT NULL AND pid IS NULL THEN 'missing_predecessor' END, CASE WHEN labeled_us <= p_us THEN 'revision_not_later' END, CASE WHEN pid IS NOT NULL AND target_id IS DISTINCT FROM p_target THEN 'revision_changes:target_id' END,
  CASE WHEN pid IS NOT NULL AND annotator_id IS DISTINCT FROM p_annotator THEN 'revision_changes:annotator_id' END], lambda r: r IS NOT NULL)) AS reason FROM x)"""
EFFECTIVE = ISSUES + """,
good AS (SELECT * FROM annotations WHERE annotation_id NOT IN (SELECT annotation_id FROM reasons)),
kids AS (SELECT target_id, annotator_id, supersedes, count(*) AS c FROM good WHERE supersedes IS NOT NULL GROUP BY ALL),
heads AS (SELECT *, count(*) OVER (PARTITION BY target_id, annotator_id) AS heads FROM good g WHERE NOT EXISTS (SELECT 1 FROM kids k WHERE k.supersedes = g.annotation_id AND k.target_id = g.target_id AND k.annotator_id = g.annotator_id)),
eff AS (SELECT * FROM heads h WHERE heads = 1 AND NOT retracted AND NOT EXISTS (SELECT 1 FROM kids k WHERE k.c > 1 AND k.target_id = h.target_id AND k.annotator_id = h.annotator_id))"""
PAIRS = EFFECTIVE + """,
lab AS (SELECT target_id, annotator_id, arg_max(label, (labeled_us, annotation_id)) AS label FROM eff WHERE label IS NOT NULL GROUP BY ALL),
pairs AS (SELECT l.annotator_id AS "left", r.annotator_id AS "right", l.label AS x, r.label AS y, coalesce(k.task_family, 'unknown') AS category FROM lab l JOIN lab r ON l.target_id = r.target_id AND l.annotator_id < r.annotator_id
  LEFT JOIN traces t ON t.trace_id = l.target_id LEFT JOIN tasks k USING (task_id))"""


def weight(ident: str) -> str:
    """How often resample ``rep`` takes the row ``ident``."""
    part = f"substr(md5('42:' || (rep // 4) || ':' || {ident}), CAST(rep % 4 * 8 + 1 AS INT), 8)"
    steps = " ".join(f"WHEN {part} < '{s}' THEN {n}" for n, s in enumerate(poisson_steps()))
    return f"CASE {steps} ELSE {len(poisson_steps())} END"


def paired(value: str, keep: str) -> str:
    return CANON + f""", p AS (SELECT task_id, x.v AS x, y.v AS y, y.v - x.v AS d
  FROM (SELECT task_id, CAST(b.{value} AS DOUBLE) AS v FROM canon WHERE model_id = 'm0' AND {keep}) x JOIN (SELECT task_id, CAST(b.{value} AS DOUBLE) AS v FROM canon WHERE model_id = 'm1' AND {keep}) y USING (task_id)),
draws AS (SELECT rep, d, unnest(range(w)) FROM (SELECT rep, d, {weight("task_id")} AS w FROM p, range(300) r(rep)))"""


BODY = {
    "q01": "SELECT count(*) AS total_traces, count_if(status = 'success') AS success, count_if(status = 'error') AS error, count_if(status NOT IN ('success', 'error')) AS other FROM traces",
    "q02": "SELECT trace_id, session_id, turn, duration_ms, error_type, tool_count, start_us FROM traces WHERE status = 'error'",
    "q03": "SELECT session_id, trace_id, turn, status, end_us FROM traces QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY end_us DESC, trace_id DESC) = 1",
    "q04": "SELECT trace_id, status, duration_ms, tool_count, llm_rounds FROM traces WHERE duration_ms = (SELECT max(duration_ms) FROM traces)",
    "q05": "SELECT replace(name, 'tool:', '') AS tool_name, count(*) AS total, count_if(status = 'success') AS success, count_if(status = 'error') AS error FROM observations WHERE type = 'tool' GROUP BY 1",
    "q06": "SELECT observation_id, trace_id, replace(name, 'tool:', '') AS tool_name, tool_index, (end_us - start_us) // 1000 AS duration_ms FROM observations WHERE type = 'tool' AND status = 'error'",
    "q07": "SELECT trace_id, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens, cache_tokens, coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS both_tokens, both_tokens = max(both_tokens) OVER () AS has_most FROM traces",
    "q08": "SELECT t.trace_id, count(o.trace_id) AS generation_count, list_sort(list(o.ms))[CAST(ceil(0.95 * count(o.trace_id)) AS BIGINT)] AS p95_ms FROM traces t LEFT JOIN (SELECT trace_id, (end_us - start_us) // 1000 AS ms FROM observations WHERE type = 'generation') o USING (trace_id) GROUP BY 1",
    "q09": "SELECT trace_id, observation_id, replace(name, 'tool:', '') AS tool_name, status, (end_us - start_us) // 1000 AS duration_ms FROM observations WHERE type = 'tool' ORDER BY duration_ms DESC, trace_id, observation_id LIMIT 5",
    "q10": "SELECT status, count(*) AS trace_count, round(avg(duration_ms), 3) AS mean_duration_ms, round(avg(tool_count), 3) AS mean_tool_count, round(avg(coalesce(input_tokens, 0)), 3) AS mean_input_tokens, round(avg(coalesce(output_tokens, 0)), 3) AS mean_output_tokens FROM traces WHERE status IN ('success', 'error') GROUP BY 1",
    "q11": "SELECT f.trace_id AS failed_trace_id, f.session_id, s.trace_id IS NOT NULL AS found, s.trace_id AS next_trace_id, round((s.start_us - f.end_us) / 1e6, 6) AS gap_seconds FROM (SELECT * FROM traces WHERE status = 'error') f LEFT JOIN (SELECT * FROM traces WHERE status = 'success') s ON s.session_id = f.session_id AND s.start_us > f.end_us QUALIFY row_number() OVER (PARTITION BY f.trace_id ORDER BY s.start_us, s.trace_id) = 1",
    "q12": "SELECT session_id, string_agg(status, ',' ORDER BY start_us, trace_id) AS status_sequence, string_agg(trace_id, ',' ORDER BY start_us, trace_id) AS trace_sequence FROM traces GROUP BY 1",
    "q13": r"SELECT trace_id, coalesce(regexp_matches(output, '\S'), FALSE) AS output_available, CASE WHEN regexp_matches(output, '\S') THEN length(output) END AS characters FROM traces",
    "q14": r"SELECT t.trace_id, coalesce(string_agg(DISTINCT v, ',' ORDER BY v), '') AS versions, count(DISTINCT v) AS version_count FROM traces t LEFT JOIN (SELECT trace_id, lower(unnest(regexp_extract_all(output, '(?i)notebook_v\d+'))) AS v FROM (SELECT trace_id, output FROM traces UNION ALL SELECT trace_id, output FROM observations)) m USING (trace_id) GROUP BY 1",
    "q15": r"""SELECT 'missing_model' AS "check", count(*) AS n FROM traces WHERE model_id IS NULL UNION ALL SELECT 'missing_output', count(*) FROM traces WHERE NOT coalesce(regexp_matches(output, '\S'), FALSE) UNION ALL SELECT 'missing_usage', count(*) FROM traces WHERE input_tokens IS NULL AND output_tokens IS NULL
      UNION ALL SELECT 'not_one_root', count(*) FROM traces t WHERE (SELECT count(*) FROM observations o WHERE o.trace_id = t.trace_id AND parent_id IS NULL) <> 1 UNION ALL SELECT 'broken_trace_link', count(*) FROM observations WHERE trace_id NOT IN (SELECT trace_id FROM traces)
      UNION ALL SELECT 'broken_parent_link', count(*) FROM observations WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT observation_id FROM observations) UNION ALL SELECT 'start_after_end', (SELECT count(*) FROM traces WHERE start_us > end_us) + (SELECT count(*) FROM observations WHERE start_us > end_us)""",
    "q16": """SELECT answer_id, array_to_string(list_filter([CASE WHEN (SELECT count(*) FROM observations o WHERE o.trace_id = a.trace_id AND parent_id IS NULL) <> 1 THEN 'ambiguous_root_observation' END, CASE WHEN count(*) OVER (PARTITION BY task_id, model_id, trace_id) > 1 THEN 'duplicate_answer_link' END,
      CASE WHEN task_id NOT IN (SELECT task_id FROM tasks) THEN 'missing_task' END, CASE WHEN trace_id NOT IN (SELECT trace_id FROM traces) THEN 'missing_trace' END], lambda r: r IS NOT NULL), ',') AS issues FROM answers a QUALIFY issues <> ''""",
    "q17": (paired("correct", "b.correct IS NOT NULL"), f"""SELECT pairs, accuracy_a, accuracy_b, difference, only_a, only_b, low, high, round({BINOM.format(b="only_a", c="only_b")}, 6) AS mcnemar_p FROM (SELECT count(*) AS pairs, round(avg(x), 6) AS accuracy_a, round(avg(y), 6) AS accuracy_b, round(avg(d), 6) AS difference, count_if(x > y) AS only_a, count_if(y > x) AS only_b FROM p),
      (SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM (SELECT rep, avg(d) AS m FROM draws GROUP BY 1))"""),
    "q18": (paired("duration_ms", "b.status = 'success'"), "SELECT pairs, median_difference_ms, low, high FROM (SELECT count(*) AS pairs, round(median(d), 6) AS median_difference_ms FROM p), (SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM (SELECT rep, median(d) AS m FROM draws GROUP BY 1))"),
    "q19": (CANON + """, common AS (SELECT task_id FROM canon GROUP BY 1 HAVING count(DISTINCT model_id) = (SELECT count(DISTINCT model_id) FROM canon)),
      m AS (SELECT model_id, count(b.correct) AS graded, count_if(b.cost IS NOT NULL AND b.duration_ms IS NOT NULL) AS whole, any_value(nc) AS tasks, count(b.correct) = any_value(nc) AND count_if(b.cost IS NOT NULL AND b.duration_ms IS NOT NULL) = any_value(nc) AS eligible, avg(CAST(b.correct AS DOUBLE)) AS a, avg(b.cost) AS c, avg(b.duration_ms) AS l FROM canon, (SELECT count(*) AS nc FROM common) WHERE task_id IN (FROM common) GROUP BY 1)""",
      "SELECT model_id, graded, whole, tasks, eligible, round(a, 6) AS accuracy, round(c, 6) AS cost, round(l, 6) AS latency, eligible AND NOT EXISTS (SELECT 1 FROM m o WHERE o.eligible AND o.model_id <> m.model_id AND o.a >= m.a AND o.c <= m.c AND o.l <= m.l AND (o.a > m.a OR o.c < m.c OR o.l < m.l)) AS on_frontier FROM m"),
    "q20": (CANON + f""", pp AS (SELECT task_id, difficulty, y.v - x.v AS d FROM (SELECT task_id, CAST(b.correct AS DOUBLE) AS v FROM canon WHERE model_id = 'm0' AND b.correct IS NOT NULL) x
      JOIN (SELECT task_id, CAST(b.correct AS DOUBLE) AS v FROM canon WHERE model_id = 'm1' AND b.correct IS NOT NULL) y USING (task_id) JOIN tasks USING (task_id) WHERE difficulty IN ('easy', 'hard')),
      dr AS (SELECT rep, difficulty, d, unnest(range(w)) FROM (SELECT rep, difficulty, d, {weight("task_id")} AS w FROM pp, range(300) r(rep)))""",
      "SELECT tasks, interaction, low, high FROM (SELECT count(*) AS tasks, round(avg(d) FILTER (difficulty = 'hard') - avg(d) FILTER (difficulty = 'easy'), 6) AS interaction FROM pp), (SELECT round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high FROM (SELECT rep, avg(d) FILTER (difficulty = 'hard') - avg(d) FILTER (difficulty = 'easy') AS s FROM dr GROUP BY 1))"),
    "q21": (CANON + f""", w AS (WITH RECURSIVE walk AS (SELECT observation_id, trace_id, parent_id AS next, 1 AS depth FROM observations UNION ALL SELECT w.observation_id, w.trace_id, o.parent_id, depth + 1 FROM walk w LEFT JOIN observations o ON o.observation_id = w.next WHERE w.next IS NOT NULL) SELECT trace_id, max(depth) AS deep FROM walk GROUP BY 1),
      comp AS (SELECT trace_id, coalesce(deep, 0) + coalesce(c, 0) AS complexity FROM traces LEFT JOIN w USING (trace_id) LEFT JOIN (SELECT trace_id, count_if(type IN ('tool', 'generation')) AS c FROM observations GROUP BY 1) USING (trace_id)),
      base AS (SELECT task_id, model_id, CAST(complexity AS DOUBLE) AS x, CAST(b.correct AS DOUBLE) AS y FROM canon JOIN comp ON comp.trace_id = b.trace_id WHERE b.correct IS NOT NULL),
      rk AS (SELECT task_id, model_id, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM base),
      rho AS (SELECT count(*) AS answers, {CORR.format(x="rx", y="ry")} AS rho FROM rk),
      sh AS (SELECT rep, task_id, rx, ry, row_number() OVER (PARTITION BY rep, task_id ORDER BY model_id) AS k, row_number() OVER (PARTITION BY rep, task_id ORDER BY {U.format("'42:' || rep || ':' || task_id || ':' || model_id")}, model_id) AS j FROM rk, range(300) r(rep)),
      each AS (SELECT a.rep, {CORR.format(x="a.rx", y="s.ry")} AS r FROM sh a JOIN sh s ON a.rep = s.rep AND a.task_id = s.task_id AND a.k = s.j GROUP BY 1)""",
      "SELECT any_value(answers) AS answers, round(any_value(rho), 6) AS rho, round((count_if(abs(r) >= abs(rho) - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM each, rho"),
    "q22": ("""tab AS (SELECT count_if(t AND f) AS a, count_if(t AND NOT f) AS b, count_if(NOT t AND f) AS c, count_if(NOT t AND NOT f) AS d FROM (SELECT status <> 'success' AS f, trace_id IN (SELECT trace_id FROM observations WHERE type = 'tool' AND status <> 'success') AS t FROM traces)),
      lp AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS k, range(greatest(0, a - d), least(a + b, a + c) + 1) AS xs FROM tab),
      pr AS (SELECT a, b, c, d, x, exp(k - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)) AS p, exp(k - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1)) AS p0 FROM (SELECT *, unnest(xs) AS x FROM lp))""",
      "SELECT a, b, c, d, round((a / (a + b)) / (c / (c + d)), 6) AS risk_ratio, round(exp(ln((a / (a + b)) / (c / (c + d))) - 1.96 * sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))), 6) AS low, round(exp(ln((a / (a + b)) / (c / (c + d))) + 1.96 * sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))), 6) AS high, round(least(1.0, sum(p) FILTER (p <= p0 * (1 + 1e-7))), 6) AS fisher_p FROM pr GROUP BY a, b, c, d"),
    "q23": ("""r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY attempt_number, start_us, trace_id) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM traces), f AS (SELECT session_id, min(i) FILTER (status <> 'success') AS first FROM r GROUP BY 1),
      u AS (SELECT session_id, max(n) - max(first) AS retries, max(CASE WHEN i > first AND status = 'success' THEN 1 ELSE 0 END) AS rec FROM r JOIN f USING (session_id) WHERE first IS NOT NULL GROUP BY 1), g AS (SELECT retries, count(*) AS n, sum(rec) AS r FROM u GROUP BY 1),
      q AS (SELECT sum(r) / sum(n) AS p, sum(n * retries) / sum(n) AS m FROM g), z AS (SELECT sum(retries * (r - n * p)) / sqrt(any_value(p * (1 - p)) * sum(n * (retries - m) ** 2)) AS z FROM g, q)""",
      "SELECT retries AS retry_count, n AS sessions, CAST(r AS BIGINT) AS recovered, round((SELECT CASE WHEN isfinite(z) THEN z END FROM z), 6) AS trend_z FROM g"),
    "q24": (f"""fl AS (SELECT name[6:] AS tool, count(*) AS c FROM observations WHERE type = 'tool' AND status <> 'success' GROUP BY 1), pl AS (SELECT tool, c, sum(c) OVER (ORDER BY tool) AS e, sum(c) OVER () AS t FROM fl),
      dr AS (SELECT rep, floor({U.format("'42:' || rep || ':' || observation_id")} * t) AS j FROM observations, (SELECT any_value(t) AS t FROM pl), range(300) r(rep) WHERE type = 'tool' AND status <> 'success'),
      ag AS (SELECT rep, tool, count(*) AS c FROM dr JOIN pl ON j < e AND j >= e - pl.c GROUP BY 1, 2 UNION ALL SELECT -1, tool, c FROM fl), rr AS (SELECT rep, c, row_number() OVER (PARTITION BY rep ORDER BY c) AS r, sum(c) OVER (PARTITION BY rep) AS t, count(*) OVER (PARTITION BY rep) AS m FROM ag),
      hg AS (SELECT rep, sum((c / t) ** 2) AS hhi, 2 * sum(r * c) / (any_value(m) * any_value(t)) - (any_value(m) + 1) / any_value(m) AS gini FROM rr GROUP BY 1)""",
      """SELECT 'all' AS tool, (SELECT CAST(sum(c) AS BIGINT) FROM fl) AS failures, 1.0::DOUBLE AS share, round(any_value(hhi) FILTER (rep < 0), 6) AS hhi, round(quantile_cont(hhi, 0.025) FILTER (rep >= 0), 6) AS hhi_low, round(quantile_cont(hhi, 0.975) FILTER (rep >= 0), 6) AS hhi_high,
      round(any_value(gini) FILTER (rep < 0), 6) AS gini, round(quantile_cont(gini, 0.025) FILTER (rep >= 0), 6) AS gini_low, round(quantile_cont(gini, 0.975) FILTER (rep >= 0), 6) AS gini_high FROM hg UNION ALL SELECT tool, c, round(c / t, 6), NULL, NULL, NULL, NULL, NULL, NULL FROM pl"""),
    "q25": ("""o AS (SELECT row_number() OVER w AS s, sum(ok) OVER w AS k, sum(ms) OVER w AS x, sum(ms * ms) OVER w AS xx, count(*) OVER () AS n, sum(ok) OVER () AS ka, sum(ms) OVER () AS xa, sum(ms * ms) OVER () AS xxa FROM (SELECT *, CAST(status = 'success' AS INT) AS ok, CAST(duration_ms AS DOUBLE) AS ms FROM traces) WINDOW w AS (ORDER BY start_us, trace_id ROWS UNBOUNDED PRECEDING)),
      zs AS (SELECT s, 'success' AS metric, (k / s - (ka - k) / (n - s)) / sqrt((ka / n) * (1 - ka / n) * (1 / s + 1 / (n - s))) AS z FROM o WHERE s BETWEEN 30 AND n - 30 UNION ALL
        SELECT s, 'latency', (x / s - (xa - x) / (n - s)) / sqrt((xx - x * x / s) / (s - 1) / s + (xxa - xx - (xa - x) ** 2 / (n - s)) / (n - s - 1) / (n - s)) FROM o WHERE s BETWEEN 30 AND n - 30),
      best AS (SELECT s, metric, z, count(*) OVER () AS tests FROM zs ORDER BY round(abs(coalesce(z, 0)), 9) DESC, s LIMIT 1)""",
      """SELECT s AS split, metric, round(z, 6) AS z, round(least(1.0, tests * greatest(0.0, 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 151), lambda k: exp(k * ln(2) + (2 * k + 1) * ln(abs(z) / sqrt(2)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))))), 6) AS p FROM best"""),
    "q26": (ISSUES, "SELECT reason, count(*) AS n FROM reasons GROUP BY 1"),
    "q27": (EFFECTIVE, "SELECT target_type, target_id, annotator_id, annotation_id, label FROM eff"),
    "q28": (PAIRS + """, ag AS (SELECT "left", "right", category, count(*) AS pairs, avg(CAST(x = y AS DOUBLE)) AS po, avg(CAST(x AS DOUBLE)) AS px, avg(CAST(y AS DOUBLE)) AS py, px * py + (1 - px) * (1 - py) AS pe FROM (SELECT "left", "right", x, y, category FROM pairs UNION ALL SELECT "left", "right", x, y, 'all' FROM pairs) GROUP BY 1, 2, 3)""",
      """SELECT "left", "right", category, pairs, round(po, 6) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 6) AS kappa FROM ag"""),
    "q29": (PAIRS + f""", s0 AS (SELECT "left", "right", count(*) AS pairs, round(avg(CAST(x AS DOUBLE)), 6) AS left_rate, round(avg(CAST(y AS DOUBLE)), 6) AS right_rate, count_if(x AND NOT y) AS only_left, count_if(y AND NOT x) AS only_right FROM pairs GROUP BY 1, 2), s1 AS (SELECT *, {BINOM.format(b="only_left", c="only_right")} AS p0 FROM s0),
      s2 AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p0, "left", "right") + 1) * p0) AS h FROM s1)""",
      """SELECT "left", "right", pairs, left_rate, right_rate, only_left, only_right, round(p0, 6) AS p, round(max(h) OVER (ORDER BY p0, "left", "right" ROWS UNBOUNDED PRECEDING), 6) AS holm_p FROM s2"""),
    "q30": """SELECT 'delay' AS k, count(*) AS n, round(median((ingested_us - labeled_us) / 1e6), 6) AS median_s, round(quantile_cont((ingested_us - labeled_us) / 1e6, 0.95), 6) AS p95_s FROM annotations
      UNION ALL SELECT k, count(*), NULL, NULL FROM (SELECT CASE o.label WHEN TRUE THEN 'True' WHEN FALSE THEN 'False' ELSE 'None' END || '->' || CASE WHEN a.retracted THEN 'RETRACTED' WHEN a.label THEN 'True' WHEN NOT a.label THEN 'False' ELSE 'None' END AS k FROM annotations a JOIN annotations o ON a.supersedes = o.annotation_id) GROUP BY 1""",
}


def long_counts(text: str) -> str:
    """count_if(x) as count(*) FILTER (WHERE x), which is a BIGINT."""
    while (i := text.find("count_if(")) >= 0:
        depth, j = 1, i + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        text = f"{text[:i]}count(*) FILTER (WHERE {text[i + len('count_if(') : j - 1]}){text[j:]}"
    return text


def sql(name: str) -> str:
    more, body = BODY[name] if isinstance(BODY[name], tuple) else ("", BODY[name])
    return long_counts("WITH " + STAND_IN_SQL + (",\n" + more if more else "") + "\n" + body)


def over_bundle(body: str) -> str:
    return long_counts("WITH " + STAND_IN_SQL + "\n" + body)
