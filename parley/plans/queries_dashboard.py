"""Dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.plans import dashboard as D
from parley.plans import sql_pipeline, sql_rules  # noqa: F401  (register oracle views)
from parley.plans.catalog import query
from parley.plans.sql import with_views


def dashboard_inputs(t):
    return t.events, t.escalations, t.violations, t.tickets, t.users


_BASE = ("base", """
    SELECT (SELECT count(*) FROM ev WHERE event_type = 'query') AS q,
           (SELECT count(*) FROM esc) AS n_esc,
           (SELECT count(*) FROM ev WHERE event_type = 'escalation') AS esc_ev,
           (SELECT avg(response_time_ms) FROM ev WHERE response_time_ms IS NOT NULL) AS avg_rt,
           (SELECT count(*) FROM viol) AS n_viol,
           (SELECT count(*) FROM tkt WHERE status != 'resolved') AS open_t,
           (SELECT count(*) FROM usr WHERE role = 'student') AS students,
           (SELECT count(*) FROM tkt WHERE status = 'resolved') AS resolved_t""")
_RATED = ("rated", "SELECT *, round_even(esc_ev / greatest(q, 1) * 100, 1) AS rate FROM base")
_SAT = "greatest(0.0, least(100.0, 100.0 - rate * 2 - n_viol * 3))"
_SRC = ("ev", "esc", "viol", "tkt", "usr")


@query("dash_totals", with_views("""
    SELECT q AS total_queries, n_esc AS total_escalations, esc_ev AS escalation_events, avg_rt,
           n_viol AS total_violations, open_t AS open_tickets, students AS total_students,
           resolved_t AS resolved_tickets FROM base""", *_SRC, extra=[_BASE]))
def dash_totals(t):
    """A1, A2, A5-A8 and the two raw inputs of A3/A4, in one aggregate."""
    return D.totals(*dashboard_inputs(t))


@query("dash_snapshot", with_views(f"""
    SELECT q AS total_queries, n_esc AS total_escalations, rate AS escalation_rate,
           COALESCE(CAST(round_even(avg_rt, 0) AS BIGINT), 0) AS avg_response_time_ms,
           n_viol AS total_violations, open_t AS open_tickets, students AS total_students,
           resolved_t AS resolved_tickets, {_SAT} AS satisfaction_score
    FROM rated""", *_SRC, extra=[_BASE, _RATED]))
def dash_snapshot(t):
    """A13 scalars (A1-A8 with A3 rate, A4 mean, A12 satisfaction)."""
    return D.snapshot_scalars(*dashboard_inputs(t))


@query("dash_rate_score", with_views(f"""
    SELECT rate AS escalation_rate, {_SAT} AS satisfaction_score, q AS total_queries FROM rated""",
                                     *_SRC, extra=[_BASE, _RATED]))
def dash_rate_score(t):
    """A3 + A12."""
    return D.snapshot_scalars(*dashboard_inputs(t)).select("escalation_rate", "satisfaction_score", "total_queries")


_QBA = ("qba", """
    SELECT agent_type, count(*) AS count FROM ev
    WHERE event_type = 'query' AND agent_type IS NOT NULL GROUP BY agent_type""")


@query("queries_by_agent", with_views("SELECT * FROM qba", "ev", extra=[_QBA]))
def queries_by_agent(t):
    """A9."""
    return D.queries_by_agent(t.events)


@query("agent_map", with_views("SELECT * FROM qba", "ev", extra=[_QBA]))
def agent_map(t):
    """A10: the map, read back as (key, value) rows for comparison."""
    m = D.agent_map(t.events)
    return m.select(F.explode("queries_by_agent").alias("agent_type", "count"))


@query("agent_share", with_views(
    "SELECT agent_type, count, round(count / sum(count) OVER (), 6) AS share FROM qba", "ev", extra=[_QBA]))
def agent_share(t):
    """A19."""
    return D.agent_share(t.events)


@query("bar_heights", with_views(
    "SELECT agent_type, count, round(count / greatest(max(count) OVER (), 1) * 160, 6) AS height_px FROM qba",
    "ev", extra=[_QBA]))
def bar_heights(t):
    """W5 over A9."""
    return D.bar_heights(D.queries_by_agent(t.events))


@query("response_trend", with_views("""
    SELECT CAST(created_at AS DATE) AS date, avg(response_time_ms) AS avg_time, count(*) AS count,
           strftime(CAST(created_at AS DATE), '%m-%d') AS label
    FROM ev WHERE response_time_ms IS NOT NULL
    GROUP BY CAST(created_at AS DATE) ORDER BY date DESC LIMIT 7""", "ev"))
def response_trend(t):
    """A11 / O9 / X14 / X20."""
    return D.response_trend(t.events)


@query("recent_events", with_views("SELECT * FROM ev ORDER BY created_at DESC, id DESC LIMIT 20", "ev"))
def recent_events(t):
    """O7."""
    return D.newest(t.events, 20)


@query("recent_escalations", with_views("""
    SELECT e.*, u.display_name FROM esc e JOIN usr u ON e.user_id = u.id
    ORDER BY e.created_at DESC, e.id DESC LIMIT 20""", "esc", "usr"))
def recent_escalations(t):
    """J1 / O5 / F2."""
    return D.recent_escalations(t.escalations, t.users, 20)


@query("recent_violations", with_views("SELECT * FROM viol ORDER BY created_at DESC, id DESC LIMIT 20", "viol"))
def recent_violations(t):
    """O6 (admin feed, 20); O8 (dashboard, 10) is its first half."""
    return D.newest(t.violations, 20)


@query("recent_violations_asc", with_views("""
    SELECT *, row_number() OVER (ORDER BY created_at, id) - 1 AS position
    FROM (SELECT * FROM viol ORDER BY created_at DESC, id DESC LIMIT 10)""", "viol"))
def recent_violations_asc(t):
    """O8 + W6: the dashboard's 10 newest violations, oldest first."""
    return D.oldest_first(D.newest(t.violations, 10))


@query("trend_asc", with_views("""
    SELECT *, row_number() OVER (ORDER BY date) - 1 AS position FROM (
        SELECT CAST(created_at AS DATE) AS date, avg(response_time_ms) AS avg_time, count(*) AS count,
               strftime(CAST(created_at AS DATE), '%m-%d') AS label
        FROM ev WHERE response_time_ms IS NOT NULL
        GROUP BY CAST(created_at AS DATE) ORDER BY date DESC LIMIT 7)""", "ev"))
def trend_asc(t):
    """The latest seven days, oldest first."""
    return D.oldest_first(D.response_trend(t.events), "date", "date")


@query("ticket_listing", with_views("""
    SELECT user_id, id, category, subject, status, priority, created_at,
           row_number() OVER (ORDER BY created_at DESC, id DESC) - 1 AS position, 'all' AS listing FROM tkt
    UNION ALL
    SELECT user_id, id, category, subject, status, priority, created_at,
           row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) - 1, 'own' FROM tkt""", "tkt"))
def ticket_listing(t):
    """The tickets each viewer sees, newest first."""
    return D.ticket_listing(t.tickets)


def _text(x: str) -> str:
    return f"CAST(CAST({x} AS DECIMAL(38,3)) AS VARCHAR)"


_TS = "strftime(created_at, '%Y-%m-%d %H:%M:%S.%g')"


@query("dashboard_record", with_views(f"""
    SELECT key, CAST(0 AS BIGINT) AS position, value FROM (
        SELECT unnest(['total_queries', 'total_escalations', 'escalation_rate', 'avg_response_time_ms', 'total_violations',
                       'open_tickets', 'total_students', 'resolved_tickets', 'satisfaction_score']) AS key,
               unnest([{_text('q')}, {_text('n_esc')}, {_text('rate')}, {_text('COALESCE(round_even(avg_rt, 0), 0)')}, {_text('n_viol')},
                       {_text('open_t')}, {_text('students')}, {_text('resolved_t')}, {_text(_SAT)}]) AS value FROM rated)
    UNION ALL
    SELECT 'queries_by_agent', row_number() OVER (ORDER BY agent_type) - 1, agent_type || '|' || {_text('count')} FROM qba
    UNION ALL
    SELECT 'recent_events', row_number() OVER (ORDER BY created_at DESC, id DESC) - 1,
           concat_ws('|', {_TS}, CAST(id AS VARCHAR), event_type, agent_type)
    FROM (SELECT * FROM ev ORDER BY created_at DESC, id DESC LIMIT 20)
    UNION ALL
    SELECT 'recent_violations', row_number() OVER (ORDER BY created_at DESC, id DESC) - 1,
           concat_ws('|', {_TS}, CAST(id AS VARCHAR), violation_type, severity)
    FROM (SELECT * FROM viol ORDER BY created_at DESC, id DESC LIMIT 10)
    UNION ALL
    SELECT 'response_time_trend', row_number() OVER (ORDER BY date) - 1,
           concat_ws('|', CAST(date AS VARCHAR), {_text('avg_time')}, {_text('count')})
    FROM (SELECT CAST(created_at AS DATE) AS date, avg(response_time_ms) AS avg_time, count(*) AS count
          FROM ev WHERE response_time_ms IS NOT NULL GROUP BY CAST(created_at AS DATE) ORDER BY date DESC LIMIT 7)""",
                                      *_SRC, extra=[_BASE, _RATED, _QBA]))
def dashboard_record(t):
    """All 13 keys of the dashboard (one row per scalar or list item)."""
    return D.record_rows(D.dashboard_record(*dashboard_inputs(t)))


@query("tickets_visible", with_views("""
    SELECT u.id AS user_id, u.role,
           CASE WHEN u.role = 'admin' THEN (SELECT count(*) FROM tkt) ELSE COALESCE(o.n, 0) END AS visible_tickets,
           CASE WHEN u.role = 'admin' THEN (SELECT max(created_at) FROM tkt) ELSE o.newest END AS newest_ticket_at
    FROM usr u LEFT JOIN own o ON o.user_id = u.id""", "tkt", "usr", extra=[("own", """
    SELECT user_id, count(*) AS n, max(created_at) AS newest FROM tkt GROUP BY user_id""")]))
def tickets_visible(t):
    """F9/O3 for every viewer: an admin sees all tickets, others their own.

    Reported as per-viewer count and newest time, which keeps the result
    linear in the tables (a listing per viewer would repeat the whole
    ticket table once per admin).
    """
    return D.ticket_visibility(t.tickets, t.users)


@query("courses_sorted", with_views("SELECT * FROM crs ORDER BY title, id", "crs"))
def courses_sorted(t):
    """O4."""
    return D.courses_sorted(t.courses)


@query("pipeline_dashboard", with_views(f"""
    SELECT q AS total_queries, n_esc AS total_escalations, rate AS escalation_rate,
           COALESCE(CAST(round_even(avg_rt, 0) AS BIGINT), 0) AS avg_response_time_ms,
           n_viol AS total_violations, open_t AS open_tickets, students AS total_students,
           resolved_t AS resolved_tickets, {_SAT} AS satisfaction_score
    FROM prated""", "pev", "pesc", "pviol", "tkt", "usr", extra=[("pbase", """
    SELECT (SELECT count(*) FROM pev WHERE event_type = 'query') AS q,
           (SELECT count(*) FROM pesc) AS n_esc,
           (SELECT count(*) FROM pev WHERE event_type = 'escalation') AS esc_ev,
           (SELECT avg(response_time_ms) FROM pev WHERE response_time_ms IS NOT NULL) AS avg_rt,
           (SELECT count(*) FROM pviol) AS n_viol,
           (SELECT count(*) FROM tkt WHERE status != 'resolved') AS open_t,
           (SELECT count(*) FROM usr WHERE role = 'student') AS students,
           (SELECT count(*) FROM tkt WHERE status = 'resolved') AS resolved_t"""),
    ("prated", "SELECT *, round_even(esc_ev / greatest(q, 1) * 100, 1) AS rate FROM pbase")]))
def pipeline_dashboard(t):
    """Flagship: dashboard (A13) over the tables the pipeline derives
    from the messages (P1 -> P2/P3/P4), plus tickets and users."""
    from parley.plans.flagship import pipeline_dashboard as flow
    return flow(t)
