"""Registered temporal queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import histories as hs
from attestry.operators import temporal as tp
from attestry.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


A = """
WITH a AS (
  SELECT event_id + 1 AS evidence_id, 'user' AS subject_type, CAST(user_id AS VARCHAR) AS subject_id, event_type AS state,
         ['day','hour','minute','second'][event_id % 4 + 1] AS precision, date_trunc('second', ts) AS t FROM events
), i AS (
  SELECT evidence_id, subject_type, subject_id, state, precision, t AS "start",
         CASE precision WHEN 'day' THEN date_trunc('day', t) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND
              WHEN 'hour' THEN date_trunc('hour', t) + INTERVAL 1 HOUR - INTERVAL 1 MICROSECOND
              WHEN 'minute' THEN date_trunc('minute', t) + INTERVAL 1 MINUTE - INTERVAL 1 MICROSECOND ELSE t END AS "end"
  FROM a
)"""


def rel(a: str, b: str, c: str, d: str) -> str:
    return f"""CASE WHEN {b} < {c} THEN 'before' WHEN {a} > {d} THEN 'after' WHEN {b} = {c} THEN 'meets' WHEN {a} = {c} AND {b} = {d} THEN 'at'
      WHEN {a} <= {c} AND {b} >= {d} THEN CASE WHEN {a} = {c} THEN 'started_by' WHEN {b} = {d} THEN 'ended_by' ELSE 'contains' END
      WHEN {c} <= {a} AND {d} >= {b} THEN CASE WHEN {a} = {c} THEN 'starts' WHEN {b} = {d} THEN 'ends' ELSE 'during' END ELSE 'overlaps' END"""


def _intervals(spark, base):
    return tp.precision_intervals(tables.assertions(spark, base))


@query(A + ' SELECT evidence_id, precision, "start", "end" FROM i')
def precision_intervals(spark, base):
    return _intervals(spark, base).select("evidence_id", "precision", "start", "end")


PAIR = A + f""", p AS (
  SELECT l.subject_id, l.evidence_id AS left_id, r.evidence_id AS right_id, {rel('l."start"', 'l."end"', 'r."start"', 'r."end"')} AS relation
  FROM i l JOIN i r ON l.subject_id = r.subject_id AND l.evidence_id < r.evidence_id)"""


@query(PAIR + " SELECT relation, CASE WHEN relation = 'overlaps' THEN 'indeterminate' ELSE 'definite' END AS certainty, count(*) AS pairs, sum(left_id) AS left_sum, sum(right_id) AS right_sum FROM p GROUP BY 1, 2".replace("sum(left_id)", "CAST(sum(left_id) AS BIGINT)").replace("sum(right_id)", "CAST(sum(right_id) AS BIGINT)"))
def precision_relations(spark, base):
    pairs = tp.pair_relations(_intervals(spark, base), ["subject_id"], exact=False)
    return pairs.groupBy("relation", "certainty").agg(F.count("*").alias("pairs"), F.sum("left_id").alias("left_sum"), F.sum("right_id").alias("right_sum"))


EXACT = """
WITH e AS (
  SELECT event_id + 1 AS evidence_id, user_id, date_trunc('hour', ts) AS s, date_trunc('hour', ts) + INTERVAL 1 HOUR * (1 + event_id % 48) AS t FROM events
), p AS (
  SELECT l.s a, l.t b, r.s c, r.t d FROM e l JOIN e r ON l.user_id = r.user_id AND l.evidence_id < r.evidence_id
)
SELECT CASE WHEN b < c THEN 'before' WHEN b > d AND a > c THEN 'after' WHEN b = c THEN 'meets' WHEN a = d THEN 'after' WHEN a = c AND b = d THEN 'at'
  WHEN a <= c AND b >= d THEN CASE WHEN a = c THEN 'started_by' WHEN b = d THEN 'ended_by' ELSE 'contains' END
  WHEN c <= a AND d >= b THEN CASE WHEN a = c THEN 'starts' WHEN b = d THEN 'ends' ELSE 'during' END
  WHEN a < d AND b > c THEN 'overlaps' WHEN a > d THEN 'after' ELSE 'before' END AS relation, count(*) AS pairs
FROM p GROUP BY 1"""


@query(EXACT)
def interval_relations(spark, base):
    events = tables.table(spark, base, "events")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    rows = events.select((F.col("event_id") + 1).alias("evidence_id"), "user_id", hour.alias("s"), (F.col("event_id") % 48 + 1).cast("int").alias("h")).select(
        "evidence_id", "user_id", F.date_format("s", "yyyy-MM-dd'T'HH:mm:ss").alias("start_time"),
        F.date_format(F.expr("s + make_dt_interval(0, h)"), "yyyy-MM-dd'T'HH:mm:ss").alias("end_time"), F.lit("second").alias("precision"),
    )
    return tp.pair_relations(tp.plain_intervals(rows), ["user_id"]).groupBy("relation").agg(F.count("*").alias("pairs"))


@query(A + f""" SELECT l.subject_type, l.subject_id, l.evidence_id AS left_id, r.evidence_id AS right_id, l.state AS left_state, r.state AS right_state,
  {rel('l."start"', 'l."end"', 'r."start"', 'r."end"')} AS relation
  FROM i l JOIN i r ON l.subject_id = r.subject_id AND l.evidence_id < r.evidence_id AND l.state <> r.state
  WHERE relation IN ('at','contains','during','starts','started_by','ends','ended_by')""")
def state_contradictions(spark, base):
    return tp.contradictions(_intervals(spark, base))


@query(PAIR + """ SELECT 'user' AS subject_type, s.subject_id, s.n AS assertions, coalesce(c, 0) AS comparisons, coalesce(k, 0) AS definite, coalesce(c - k, 0) AS indeterminate, CAST(0 AS BIGINT) AS conflicts
  FROM (SELECT subject_id, count(*) n FROM i GROUP BY 1) s LEFT JOIN (SELECT subject_id, count(*) c, count(*) FILTER (WHERE relation <> 'overlaps') k FROM p GROUP BY 1) x USING (subject_id)""")
def consistency_report(spark, base):
    return tp.consistency_report(_intervals(spark, base))


LINE = A + f""", n AS (
  SELECT *, row_number() OVER w - 1 AS position, lead(evidence_id) OVER w AS ne, lead(state) OVER w AS ns, lead("start") OVER w AS nstart, lead("end") OVER w AS nend
  FROM i WINDOW w AS (PARTITION BY subject_id ORDER BY "start", "end", evidence_id)
), line AS (
  SELECT subject_type, subject_id, position, evidence_id, state, "start", "end", ne AS next_evidence_id, ns AS next_state,
    CASE WHEN ne IS NOT NULL THEN {rel('"start"', '"end"', 'nstart', 'nend')} END AS relation,
    CASE WHEN ne IS NOT NULL THEN CASE WHEN {rel('"start"', '"end"', 'nstart', 'nend')} = 'overlaps' THEN 'indeterminate' ELSE 'definite' END END AS certainty FROM n
)"""


def _lines(spark, base):
    return tp.timeline(_intervals(spark, base))


@query(LINE + " SELECT * FROM line")
def state_timeline(spark, base):
    return _lines(spark, base)


@query(LINE + """ SELECT subject_type, subject_id, count(ne) AS transitions, count(*) FILTER (WHERE state <> ns) AS changed, count(*) FILTER (WHERE state = ns) AS unchanged,
  count(*) FILTER (WHERE certainty = 'definite') AS definite, count(*) FILTER (WHERE certainty = 'indeterminate') AS indeterminate
  FROM (SELECT *, next_evidence_id ne, next_state ns FROM line) GROUP BY 1, 2""")
def transition_analysis(spark, base):
    return tp.transition_analysis(_lines(spark, base))


@query(LINE + """ SELECT subject_type, subject_id, count(*) AS observation_count, count(DISTINCT state) AS distinct_state_count, arg_min(state, position) AS initial_state,
  arg_max(state, position) AS final_state, count(next_evidence_id) AS transition_count, count(*) FILTER (WHERE state <> next_state) AS change_count,
  count(*) FILTER (WHERE certainty = 'indeterminate') AS indeterminate_count, coalesce(bool_or(certainty = 'indeterminate'), false) AS has_temporal_uncertainty FROM line GROUP BY 1, 2""")
def state_history(spark, base):
    return tp.state_history(_lines(spark, base))


@query(A + ' SELECT subject_type, subject_id, state, count(*) AS assertions, list(evidence_id ORDER BY "start", "end", evidence_id) AS evidence_ids FROM i GROUP BY 1, 2, 3')
def evidence_by_state(spark, base):
    return tp.grouped_evidence(_intervals(spark, base), by_state=True)


RUNS = LINE + """, ch AS (SELECT *, CASE WHEN lag(state) OVER w <> state THEN 1 ELSE 0 END AS c FROM line WINDOW w AS (PARTITION BY subject_id ORDER BY position)
), rn AS (SELECT *, CAST(sum(c) OVER (PARTITION BY subject_id ORDER BY position) AS BIGINT) AS run FROM ch
), runs AS (SELECT subject_type, subject_id, run, arg_min(state, position) AS state, min(position) AS first_position, max(position) AS last_position, count(*) AS length FROM rn GROUP BY 1, 2, 3)"""


@query(RUNS + " SELECT * FROM runs")
def stable_runs(spark, base):
    return tp.stable_runs(_lines(spark, base))


CHANGES = RUNS + """, cp AS (
  SELECT subject_type, subject_id, first_position + 1 AS index, lag(state) OVER w AS previous_state, state AS new_state, lag(length) OVER w AS length_before, length AS length_after, run
  FROM runs WINDOW w AS (PARTITION BY subject_id ORDER BY run)
), changes AS (SELECT * EXCLUDE (run), least(length_before, length_after) AS score, least(length_before, length_after) > 1 AS persistent FROM cp WHERE run > 0)"""


@query(CHANGES + " SELECT * FROM changes")
def change_points(spark, base):
    return tp.change_points(tp.stable_runs(_lines(spark, base)))


@query(CHANGES + " SELECT subject_id, count(*) AS changes, count(*) FILTER (WHERE persistent) AS persistent, max(score) AS best FROM changes GROUP BY 1")
def change_significance(spark, base):
    changes = tp.change_points(tp.stable_runs(_lines(spark, base)))
    return changes.groupBy("subject_id").agg(F.count("*").alias("changes"), F.count_if("persistent").alias("persistent"), F.max("score").alias("best"))


@query(RUNS + " SELECT subject_type, subject_id, count(*) AS run_count, count(*) FILTER (WHERE length > 1) AS repeated_run_count, max(length) AS longest_run, CAST(sum(length) AS BIGINT) AS observations FROM runs GROUP BY 1, 2")
def transition_persistence(spark, base):
    return tp.transition_persistence(tp.stable_runs(_lines(spark, base)))


@query(RUNS + " SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY length DESC, run) = 1")
def longest_runs(spark, base):
    return tp.longest_run(tp.stable_runs(_lines(spark, base)))


# two histories of each user: events of even and of odd id, in order of time
H = """
WITH h AS (
  SELECT 'user' AS subject_type, CAST(user_id AS VARCHAR) AS subject_id, event_id % 2 AS history_id, event_id + 1 AS evidence_id, event_type AS state,
         row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS position FROM events
), tot AS (SELECT subject_id, count(DISTINCT history_id) AS history_count FROM h GROUP BY 1
), v AS (SELECT subject_id, position, state, count(*) AS n, min(history_id) AS f FROM h GROUP BY 1, 2, 3
), pos AS (
  SELECT subject_id, position, list(state ORDER BY f, state) AS states, max(n) AS support, sum(n) AS observed FROM v GROUP BY 1, 2
), cons AS (
  SELECT 'user' AS subject_type, subject_id, position, states, support, history_count,
         CASE WHEN observed < history_count THEN 'incomplete' WHEN len(states) = 1 THEN 'consensus' ELSE 'disagreement' END AS outcome FROM pos JOIN tot USING (subject_id)
)"""


def _histories(spark, base):
    from pyspark.sql import Window as W

    events = tables.table(spark, base, "events")
    w = W.partitionBy("user_id", F.col("event_id") % 2).orderBy("ts", "event_id")
    return events.select(
        F.lit("user").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"), (F.col("event_id") % 2).alias("history_id"),
        (F.col("event_id") + 1).alias("evidence_id"), F.col("event_type").alias("state"), (F.row_number().over(w) - 1).cast("long").alias("position"),
    )


def _sides(spark, base):
    h = _histories(spark, base)
    return h.where("history_id = 0"), h.where("history_id = 1")


COMPARE = H + """, c AS (
  SELECT coalesce(l.subject_id, r.subject_id) AS subject_id, coalesce(l.position, r.position) AS position, l.evidence_id AS left_evidence_id, l.state AS left_state, r.evidence_id AS right_evidence_id, r.state AS right_state,
    CASE WHEN r.state IS NULL THEN 'left_only' WHEN l.state IS NULL THEN 'right_only' WHEN l.state = r.state THEN 'matching' ELSE 'divergent' END AS kind
  FROM (SELECT * FROM h WHERE history_id = 0) l FULL JOIN (SELECT * FROM h WHERE history_id = 1) r ON l.subject_id = r.subject_id AND l.position = r.position
  WHERE coalesce(l.subject_id, r.subject_id) IN (SELECT subject_id FROM tot WHERE history_count = 2)
)"""


@query(COMPARE + " SELECT 'user' AS subject_type, * FROM c")
def history_comparison(spark, base):
    return hs.compare_histories(*_sides(spark, base))


@query(COMPARE + """ SELECT 'user' AS subject_type, subject_id, count(*) AS comparison_count, count(*) FILTER (WHERE kind = 'matching') AS shared_state_count, count(*) FILTER (WHERE kind <> 'matching') AS divergent_state_count,
  count(*) FILTER (WHERE kind = 'left_only') AS left_only_count, count(*) FILTER (WHERE kind = 'right_only') AS right_only_count, min(position) FILTER (WHERE kind <> 'matching') AS first_divergence_index,
  count(*) FILTER (WHERE kind = 'matching') / count(*) AS agreement_ratio, count(*) FILTER (WHERE kind <> 'matching') / count(*) AS divergence_ratio,
  count(*) FILTER (WHERE kind <> 'matching') > 0 AS has_divergence, count(*) FILTER (WHERE kind IN ('left_only', 'right_only')) > 0 AS has_asymmetric_observations FROM c GROUP BY 2""")
def history_divergence(spark, base):
    return hs.divergence(hs.compare_histories(*_sides(spark, base)))


@query(H + " SELECT subject_type, subject_id, position, states, support AS supporting_history_count, history_count AS total_history_count, outcome FROM cons")
def consensus_positions(spark, base):
    return hs.consensus_positions(_histories(spark, base))


@query(H + """ SELECT subject_type, subject_id, max(history_count) AS history_count, count(*) AS comparison_count, count(*) FILTER (WHERE outcome = 'consensus') AS consensus_position_count,
  count(*) FILTER (WHERE outcome = 'disagreement') AS disagreement_position_count, count(*) FILTER (WHERE outcome = 'incomplete') AS incomplete_position_count,
  bool_or(outcome = 'disagreement') AS has_disagreement, bool_or(outcome = 'incomplete') AS has_incomplete_history FROM cons GROUP BY 1, 2""")
def history_consensus(spark, base):
    return hs.history_consensus(hs.consensus_positions(_histories(spark, base)))


@query(H + """, e AS (SELECT subject_id, history_id, count(*) AS n, arg_min(state, position) AS f, arg_max(state, position) AS l FROM h GROUP BY 1, 2
), ee AS (SELECT subject_id, CAST(sum(n) AS BIGINT) AS observation_count, list(f ORDER BY history_id) AS initial_states, list(l ORDER BY history_id) AS final_states FROM e GROUP BY 1
), ds AS (SELECT subject_id, count(DISTINCT state) AS distinct_state_count FROM h GROUP BY 1
), m AS (SELECT subject_id, max(history_count) AS history_count, count(*) AS comparison_count, coalesce(list(states[1] ORDER BY position) FILTER (WHERE outcome = 'consensus'), []) AS consensus_states,
  coalesce(list(position ORDER BY position) FILTER (WHERE outcome = 'disagreement'), []) AS divergent_positions, coalesce(list(position ORDER BY position) FILTER (WHERE outcome = 'incomplete'), []) AS incomplete_positions FROM cons GROUP BY 1)
SELECT 'user' AS subject_type, subject_id, history_count, observation_count, distinct_state_count, initial_states, final_states, consensus_states, divergent_positions, incomplete_positions,
  len(consensus_states) / comparison_count AS consensus_ratio, len(divergent_positions) / comparison_count AS disagreement_ratio, observation_count / (history_count * comparison_count) AS coverage_ratio,
  len(divergent_positions) > 0 AS has_divergence, len(incomplete_positions) > 0 AS has_incomplete_history FROM m JOIN ee USING (subject_id) JOIN ds USING (subject_id)""")
def history_synthesis(spark, base):
    return hs.synthesize(_histories(spark, base))


MOVES = """SELECT {k}, count(*) AS observation_count, count(DISTINCT state) AS distinct_state_count, count(*) FILTER (WHERE state <> p1) AS transition_count, count(*) FILTER (WHERE state = p2 AND state <> p1) AS reversal_count,
  count(*) FILTER (WHERE state = p2 AND p1 = p3 AND state <> p1) AS oscillation_count FROM (SELECT *, lag(state) OVER w AS p1, lag(state, 2) OVER w AS p2, lag(state, 3) OVER w AS p3 FROM {t} WINDOW w AS (PARTITION BY {k} ORDER BY position)) GROUP BY {k}"""


def _trajectory_sql(h: str = "h", cons: str = "cons", p: str = "") -> str:
    return f""", {p}own AS ({MOVES.format(k='subject_id, history_id', t=h)}
), {p}sums AS (SELECT subject_id, CAST(sum(observation_count) AS BIGINT) AS observation_count, CAST(sum(transition_count) AS BIGINT) AS transition_count, CAST(sum(reversal_count) AS BIGINT) AS reversal_count, CAST(sum(oscillation_count) AS BIGINT) AS oscillation_count FROM {p}own GROUP BY 1
), {p}st AS (SELECT subject_id, count(DISTINCT state) AS distinct_state_count FROM {h} GROUP BY 1
), {p}fl AS (SELECT subject_id, max(history_count) AS history_count, bool_or(outcome = 'disagreement') AS has_divergence, bool_or(outcome = 'incomplete') AS has_incomplete_history FROM {cons} GROUP BY 1
), {p}ag0 AS (SELECT subject_id, position, states[1] AS state FROM {cons} WHERE outcome = 'consensus'
), {p}ag AS ({MOVES.format(k='subject_id', t=p + 'ag0')}
), {p}traj AS (SELECT 'user' AS subject_type, s.subject_id, CASE WHEN has_divergence THEN 'divergent' WHEN has_incomplete_history THEN 'incomplete' WHEN a.subject_id IS NULL THEN 'empty' WHEN a.distinct_state_count = 1 THEN 'stable'
    WHEN a.oscillation_count > 0 THEN 'oscillation' WHEN a.reversal_count > 0 THEN 'reversal' WHEN a.transition_count > 0 THEN 'transition' ELSE 'stable' END AS kind,
  s.observation_count, st.distinct_state_count, s.transition_count, s.reversal_count, s.oscillation_count, history_count, has_divergence, has_incomplete_history, false AS has_temporal_uncertainty
  FROM {p}sums s JOIN {p}st st USING (subject_id) JOIN {p}fl USING (subject_id) LEFT JOIN {p}ag a USING (subject_id))"""


@query(H + _trajectory_sql() + " SELECT * FROM traj")
def trajectory_class(spark, base):
    return hs.trajectories(_histories(spark, base))


# a history of its own for each (user, day of month mod 3) part: short sequences with every kind
HP = """
WITH h AS (
  SELECT 'user' AS subject_type, CAST(user_id AS VARCHAR) || ':' || CAST(day(ts) AS VARCHAR) AS subject_id, CAST(0 AS BIGINT) AS history_id, event_id + 1 AS evidence_id, event_type AS state,
         row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) - 1 AS position FROM events
), cons AS (SELECT subject_type, subject_id, position, [state] AS states, 1 AS support, CAST(1 AS BIGINT) AS history_count, 'consensus' AS outcome FROM h)"""


def _daily(spark, base):
    from pyspark.sql import Window as W

    events = tables.table(spark, base, "events").withColumn("d", F.dayofmonth("ts"))
    w = W.partitionBy("user_id", "d").orderBy("ts", "event_id")
    return events.select(
        F.lit("user").alias("subject_type"), F.concat_ws(":", F.col("user_id").cast("string"), F.col("d").cast("string")).alias("subject_id"), F.lit(0).cast("long").alias("history_id"),
        (F.col("event_id") + 1).alias("evidence_id"), F.col("event_type").alias("state"), (F.row_number().over(w) - 1).cast("long").alias("position"),
    )


@query(HP + _trajectory_sql() + " SELECT * FROM traj")
def trajectory_class_daily(spark, base):
    return hs.trajectories(_daily(spark, base))


LR = H + """, hl AS (SELECT * FROM h WHERE history_id = 0), hr AS (SELECT * FROM h WHERE history_id = 1
), cl AS (SELECT subject_id, position, [state] AS states, CAST(1 AS BIGINT) AS history_count, 'consensus' AS outcome FROM hl), cr AS (SELECT subject_id, position, [state] AS states, CAST(1 AS BIGINT) AS history_count, 'consensus' AS outcome FROM hr)
""" + _trajectory_sql("hl", "cl", "l_") + _trajectory_sql("hr", "cr", "r_")


@query(LR + """ SELECT subject_type, subject_id, l.kind AS left_kind, r.kind AS right_kind, l.kind <> r.kind AS kind_divergence, l.observation_count <> r.observation_count AS observation_divergence,
  l.distinct_state_count <> r.distinct_state_count AS state_divergence, l.transition_count <> r.transition_count AS transition_divergence, l.reversal_count <> r.reversal_count AS reversal_divergence,
  l.oscillation_count <> r.oscillation_count AS oscillation_divergence, false AS uncertainty_divergence, l.has_incomplete_history <> r.has_incomplete_history AS incompleteness_divergence,
  l.has_divergence <> r.has_divergence AS divergence_flag_difference FROM l_traj l JOIN r_traj r USING (subject_type, subject_id)""")
def trajectory_compare(spark, base):
    left, right = _sides(spark, base)
    return hs.compare_trajectories(hs.trajectories(left), hs.trajectories(right))


@query(LR + """, u AS (SELECT * FROM l_traj UNION ALL SELECT * FROM r_traj), k AS (SELECT subject_id, kind, count(*) AS n FROM u GROUP BY 1, 2)
SELECT 'user' AS subject_type, subject_id, CAST(sum(n) AS BIGINT) AS trajectory_count, count(*) AS kind_count, max(n) AS consensus_trajectory_count, false AS has_temporal_uncertainty, false AS has_incompleteness,
  CAST(sum(n) - max(n) AS BIGINT) AS disagreement_trajectory_count, count(*) > 1 AS has_disagreement FROM k GROUP BY 2""")
def trajectory_consensus(spark, base):
    left, right = _sides(spark, base)
    return hs.trajectory_consensus(hs.trajectories(left).union(hs.trajectories(right)))


@query(HP + _trajectory_sql() + """ SELECT t.*, evidence_ids, len(evidence_ids) AS evidence_count FROM traj t JOIN (SELECT subject_id, list(evidence_id ORDER BY position) AS evidence_ids FROM h GROUP BY 1) e USING (subject_id)""")
def evidence_trajectory(spark, base):
    h = _daily(spark, base)
    return hs.evidence_backed(h, hs.trajectories(h))


@query(HP + _trajectory_sql() + """, ch AS (SELECT *, CASE WHEN lag(state) OVER w <> state THEN 1 ELSE 0 END AS c FROM h WINDOW w AS (PARTITION BY subject_id ORDER BY position)
), rn AS (SELECT *, sum(c) OVER (PARTITION BY subject_id ORDER BY position) AS run FROM ch
), runs AS (SELECT subject_id, run, count(*) AS length FROM rn GROUP BY 1, 2
), cp AS (SELECT subject_id, run, least(lag(length) OVER (PARTITION BY subject_id ORDER BY run), length) AS score FROM runs
), mv AS (SELECT subject_id, count(*) FILTER (WHERE run > 0) AS c, count(*) FILTER (WHERE run > 0 AND score > 1) AS p FROM cp GROUP BY 1)
SELECT 'user' AS subject_type, subject_id, CAST(1 AS BIGINT) AS analysis_count, observation_count, [kind] AS trajectory_kinds, false AS has_uncertainty, has_incomplete_history AS has_incompleteness, has_divergence,
  distinct_states, evidence_count, longest_stable_run, c AS change_point_count, p AS persistent_change_point_count
FROM traj JOIN (SELECT subject_id, list_sort(list(DISTINCT state)) AS distinct_states, count(*) AS evidence_count FROM h GROUP BY 1) s USING (subject_id)
JOIN (SELECT subject_id, max(length) AS longest_stable_run FROM runs GROUP BY 1) l USING (subject_id) JOIN mv USING (subject_id)""")
def historical_synthesis(spark, base):
    h = _daily(spark, base)
    runs = tp.stable_runs(h)
    return hs.historical_synthesis(hs.trajectories(h), h, tp.change_points(runs), runs)


OBS = """
WITH o AS (
  SELECT CAST(user_id AS VARCHAR) AS entity_id, event_type AS state, CASE WHEN event_id % 6 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS valid_from, CASE WHEN event_id % 5 = 0 THEN strftime(ts, '%Y-%m-%d') END AS valid_to,
         event_id + 1 AS evidence_id, 'p' || CAST(user_id % 5 AS VARCHAR) AS source_profile, CAST(event_id AS VARCHAR) AS source_memory_id FROM events
), eh AS (
  SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY valid_from IS NULL, coalesce(valid_from, ''), valid_to IS NULL, coalesce(valid_to, ''), state, CAST(evidence_id AS VARCHAR), source_profile, source_memory_id) - 1 AS position FROM o
), et AS (SELECT *, lag(state) OVER w AS ps, lag(evidence_id) OVER w AS pe, lag(valid_from) OVER w AS pv FROM eh WINDOW w AS (PARTITION BY entity_id ORDER BY position))"""


def _observations(spark, base):
    events = tables.table(spark, base, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return events.select(
        F.col("user_id").cast("string").alias("entity_id"), F.col("event_type").alias("state"), F.when(F.col("event_id") % 6 != 0, day).alias("valid_from"), F.when(F.col("event_id") % 5 == 0, day).alias("valid_to"),
        (F.col("event_id") + 1).alias("evidence_id"), F.concat(F.lit("p"), (F.col("user_id") % 5).cast("string")).alias("source_profile"), F.col("event_id").cast("string").alias("source_memory_id"),
    )


@query(OBS + " SELECT * FROM eh")
def entity_history(spark, base):
    return hs.entity_history(_observations(spark, base))


@query(OBS + " SELECT entity_id, ps AS from_state, state AS to_state, pe AS from_evidence_id, evidence_id AS to_evidence_id, pv AS from_valid_from, valid_from AS to_valid_from FROM et WHERE ps <> state")
def entity_transitions(spark, base):
    return hs.entity_transitions(hs.entity_history(_observations(spark, base)))


@query(OBS + " SELECT entity_id, count(*) AS observation_count, count(*) FILTER (WHERE ps <> state) AS transition_count, count(valid_from) AS known_timed_observations, count(*) - count(valid_from) AS unknown_timed_observations, bool_and(valid_from IS NOT NULL) AS complete FROM et GROUP BY 1")
def entity_summary(spark, base):
    return hs.entity_summary(hs.entity_history(_observations(spark, base)))


@query(OBS + " SELECT entity_id AS source_entity_id, source_profile AS target_entity_id, state AS relation, count(*) AS observation_count, count(valid_from) AS known_timed_observations, count(*) - count(valid_from) AS unknown_timed_observations, bool_and(valid_from IS NOT NULL) AS complete, CAST(0 AS BIGINT) AS transition_count, true AS observed_active FROM o GROUP BY 1, 2, 3")
def relationship_history(spark, base):
    o = _observations(spark, base)
    return hs.relationship_history(o.select(F.col("entity_id").alias("source_entity_id"), F.col("source_profile").alias("target_entity_id"), F.col("state").alias("relation"), "valid_from"))


@query(OBS + """ SELECT entity_id, 'Entity ' || entity_id || ' was observed in state ''' || state || '''.' AS statement, list(evidence_id ORDER BY position) AS evidence_ids FROM eh GROUP BY 1, state, 2
UNION ALL SELECT entity_id, 'Entity ' || entity_id || ' has an evidence-backed observed transition from ''' || ps || ''' to ''' || state || '''.', [pe, evidence_id] FROM et WHERE ps <> state""")
def history_summaries(spark, base):
    return hs.summary_sentences(hs.entity_history(_observations(spark, base)))
