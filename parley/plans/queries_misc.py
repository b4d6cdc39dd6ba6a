"""Quality, presentation, latency and small-operator queries
(F1-F13, J2, J8-J10, S7, S8, S11, S12, S15, X10-X29)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions import present as X
from parley.functions.rules import AGENT_LABELS, DEFAULT_RULES as R
from parley.functions.text import intent_weight
from parley.operators import quality as Q
from parley.operators.latency import request_latency
from parley.operators.routing import agent_label
from parley.operators.rule_join import label_by_rules
from parley.plans import dashboard as D
from parley.plans import sql_rules as SR
from parley.plans.catalog import ORACLE, query
from parley.plans.sql import lit, with_views
from parley.sources import driver


# -- F1-F3, X11-X13, X28, S15 --------------------------------------------------------

@query("project_columns", with_views("""
    SELECT id, username, display_name, role, email,
           CAST(json_array_length(enrolled_courses) AS BIGINT) AS n_courses,
           json_extract_string(enrolled_courses, '$[0]') AS first_course,
           upper(substring(display_name, 1, 1)) AS initial
    FROM usr""", "usr"))
def project_columns(t):
    """F3 public user projection (no password hash), X11 JSON array parse, X28 initial."""
    courses = F.from_json("enrolled_courses", T.ArrayType(T.StringType()))
    return t.users.select("id", "username", "display_name", "role", "email",
                          F.size(courses).cast("long").alias("n_courses"),
                          F.try_element_at(courses, F.lit(1)).alias("first_course"),
                          X.initial(F.col("display_name")).alias("initial"))


@query("json_columns", with_views("""
    SELECT id, CAST(json_extract_string(metadata, '$.k') AS BIGINT) AS k,
           CAST(to_json([event_type, agent_type]) AS VARCHAR) AS pair_json,
           CAST(to_json(MAP {'event': event_type}) AS VARCHAR) AS map_json,
           CAST(to_json({'id': id, 'event_type': event_type}) AS VARCHAR) AS row_json
    FROM ev""", "ev"))
def json_columns(t):
    """X11 text->map, X12 array->text, X13 map->text, S15 row->JSON document."""
    e = t.events
    meta = F.from_json("metadata", T.MapType(T.StringType(), T.StringType()))
    return e.select("id", F.element_at(meta, F.lit("k")).cast("long").alias("k"),
                    F.to_json(F.array("event_type", "agent_type")).alias("pair_json"),
                    F.to_json(F.create_map(F.lit("event"), F.col("event_type"))).alias("map_json"),
                    F.to_json(F.struct("id", "event_type")).alias("row_json"))


# -- F4-F8, F10 ---------------------------------------------------------------------------

@query("filters_basic", with_views(f"""
    SELECT (SELECT count(*) FROM ev WHERE event_type = 'query') AS n_query_events,
           (SELECT count(*) FROM tkt WHERE status != 'resolved') AS n_not_resolved,
           (SELECT count(*) FROM ev WHERE response_time_ms IS NOT NULL) AS n_timed,
           (SELECT count(*) FROM ev WHERE event_type = 'query' AND agent_type IS NOT NULL) AS n_routed,
           (SELECT count(*) FROM usr WHERE role IN ('admin', 'faculty')) AS n_staff""", "ev", "tkt", "usr"))
def filters_basic(t):
    """F4 equality, F5 inequality (NULL excluded), F6 NOT NULL, F7 AND,
    F10 membership: one pass over each of the three tables."""
    is_query = F.col("event_type") == "query"
    e = t.events.select(F.count(F.when(is_query, 1)).alias("n_query_events"), F.count("response_time_ms").alias("n_timed"),
                        F.count(F.when(is_query & F.col("agent_type").isNotNull(), 1)).alias("n_routed"))
    open_ = t.tickets.select(F.count(F.when(F.col("status") != "resolved", 1))).scalar()
    staff = t.users.select(F.count(F.when(F.col("role").isin("admin", "faculty"), 1))).scalar()
    return e.select("n_query_events", open_.alias("n_not_resolved"), "n_timed", "n_routed", staff.alias("n_staff"))


@query("user_lookup", with_views("""
    SELECT l.request_id, l.username, u.id AS user_id, u.role, u.id IS NOT NULL AS found
    FROM logins l LEFT JOIN usr u ON u.username = l.username""", "logins", "usr"))
def user_lookup(t):
    """F8: users looked up by name (NULL and not found for unknown names)."""
    names = driver.lookup_requests(t.spark, t.sf_dir)
    u = t.users.select("username", F.col("id").alias("user_id"), "role")
    return names.join(u, "username", "left").select("request_id", "username", "user_id", "role",
                                                    F.col("user_id").isNotNull().alias("found"))


# -- S7, S8, F11, F13 ---------------------------------------------------------------------------

@query("ticket_intake", with_views(f"""
    SELECT request_id, user_id, COALESCE(category, 'general') AS category, {SR.strip('subject')} AS subject,
           {SR.strip("COALESCE(description, '')")} AS description,
           COALESCE(length({SR.strip('subject')}), 0) > 0 AS accepted, 'open' AS status, 'medium' AS priority
    FROM tkt_req""", "tkt_req"))
def ticket_intake(t):
    """S8 + F11 + F13: ticket form validation and defaults."""
    return Q.ticket_intake(driver.ticket_requests(t.spark, t.sf_dir)).drop("created_at")


@query("manual_escalations", with_views("""
    SELECT request_id, COALESCE(conversation_id, 0) AS conversation_id, user_id,
           COALESCE(reason, 'student_request') AS reason, COALESCE(summary, 'Student requested escalation') AS summary,
           'high' AS priority, 'pending' AS status, created_at
    FROM esc_req""", "esc_req"))
def manual_escalations(t):
    """Manual escalation requests with their defaults."""
    return Q.manual_escalations(driver.escalation_requests(t.spark, t.sf_dir))


# -- F12, J2, S12, S11 ---------------------------------------------------------------------------

NOT_NULL = {"users": ["id", "username", "password_hash", "display_name", "role"],
            "support_tickets": ["id", "user_id", "category", "subject"],
            "escalations": ["id", "conversation_id", "user_id", "reason"],
            "analytics_events": ["id", "event_type"],
            "courses": ["id", "title"]}
UNIQUE = {"users": ["id", "username"], "courses": ["title"], "support_tickets": ["id"]}
_SQL_TABLE = {"users": "usr", "support_tickets": "tkt", "escalations": "esc", "analytics_events": "ev",
              "courses": "crs"}


def _constraint_sql():
    parts = []
    for tbl, cols in NOT_NULL.items():
        for c in cols:
            parts.append(f"SELECT '{tbl}' AS table_name, 'not_null' AS check_name, '{c}' AS column_name, "
                         f"count(*) FILTER (WHERE {c} IS NULL) AS violations FROM {_SQL_TABLE[tbl]}")
    for tbl, cols in UNIQUE.items():
        for c in cols:
            parts.append(f"SELECT '{tbl}', 'unique', '{c}', (SELECT count(*) FROM (SELECT {c} FROM "
                         f"{_SQL_TABLE[tbl]} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1))")
    return with_views("\nUNION ALL\n".join(parts), *_SQL_TABLE.values())


@query("constraint_report", _constraint_sql())
def constraint_report(t):
    """NOT NULL and UNIQUE violations per table and column."""
    tables = {"users": t.users, "support_tickets": t.tickets, "escalations": t.escalations,
              "analytics_events": t.events, "courses": t.courses}
    return Q.constraint_report(tables, NOT_NULL, UNIQUE)


@query("fk_orphans", with_views("""
    SELECT 'support_tickets' AS child, 'user_id' AS column_name, 'users' AS parent,
           (SELECT count(*) FROM tkt c WHERE c.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM usr p WHERE p.id = c.user_id)) AS orphans
    UNION ALL SELECT 'support_tickets', 'user_id', 'students',
           (SELECT count(*) FROM tkt c WHERE NOT EXISTS (SELECT 1 FROM usr p WHERE p.id = c.user_id AND p.role = 'student'))
    UNION ALL SELECT 'escalations', 'user_id', 'users',
           (SELECT count(*) FROM esc c WHERE NOT EXISTS (SELECT 1 FROM usr p WHERE p.id = c.user_id))
    UNION ALL SELECT 'escalations', 'conversation_id', 'conversations',
           (SELECT count(*) FROM esc c WHERE NOT EXISTS (SELECT 1 FROM hdr p WHERE p.id = c.conversation_id))
    UNION ALL SELECT 'conversations', 'user_id', 'users',
           (SELECT count(*) FROM hdr c WHERE NOT EXISTS (SELECT 1 FROM usr p WHERE p.id = c.user_id))
    UNION ALL SELECT 'messages', 'conversation_id', 'conversations',
           (SELECT count(*) FROM msg c WHERE NOT EXISTS (SELECT 1 FROM hdr p WHERE p.id = c.conversation_id))""",
                                "tkt", "usr", "esc", "msg", extra=[("hdr", """
    SELECT DISTINCT conversation_id AS id, user_id FROM msg WHERE role = 'user'""")]))
def fk_orphans(t):
    """Rows whose foreign key has no parent (five declared keys, and
    tickets against students only, which is non-vacuous)."""
    from parley.plans.pipeline import conversation_headers
    conv = conversation_headers(t.messages)
    students = t.users.where(F.col("role") == "student")
    return Q.orphan_counts([
        ("support_tickets", t.tickets, "user_id", "users", t.users),
        ("support_tickets", t.tickets, "user_id", "students", students),
        ("escalations", t.escalations, "user_id", "users", t.users),
        ("escalations", t.escalations, "conversation_id", "conversations", conv),
        ("conversations", conv, "user_id", "users", t.users),
        ("messages", t.messages, "conversation_id", "conversations", conv),
    ])


@query("registration_accept", with_views(f"""
    SELECT request_id, copy, username,
           COALESCE(status0, CASE WHEN first_req = request_id AND first_copy = copy THEN 'accepted'
                                  ELSE 'username_taken' END) AS status,
           CASE WHEN COALESCE(status0, CASE WHEN first_req = request_id AND first_copy = copy THEN 'accepted' END)
                     = 'accepted' THEN sha256(password) END AS password_hash
    FROM r LEFT JOIN f ON f.fu = r.username""", "reg_req", "reg_existing", extra=[
    ("r0", f"""SELECT request_id, copy, {SR.strip('username')} AS username, {SR.strip('password')} AS password,
                      {SR.strip('display_name')} AS display_name FROM reg_req"""),
    ("r", """SELECT *, CASE WHEN COALESCE(username, '') = '' OR COALESCE(password, '') = '' OR COALESCE(display_name, '') = ''
                            THEN 'missing_fields' WHEN length(password) < 6 THEN 'short_password' END AS status0
             FROM r0"""),
    ("f", """SELECT username AS fu, arg_min(request_id, (request_id, copy)) AS first_req,
                    arg_min(copy, (request_id, copy)) AS first_copy
             FROM r WHERE status0 IS NULL AND username NOT IN (SELECT username FROM reg_existing)
             GROUP BY username""")]))
def registration_accept(t):
    """Sign-up validation in arrival order (fields, password length,
    existing or earlier-accepted username)."""
    return Q.registration(driver.registration_requests(t.spark, t.sf_dir), driver.existing_users(t.spark, t.sf_dir))


@query("last_activity", with_views("""
    SELECT user_id, max(created_at) AS last_login FROM ev WHERE user_id IS NOT NULL GROUP BY user_id""", "ev"))
def last_activity(t):
    """S11 (re-aimed): latest activity time per user."""
    return t.events.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.max("created_at").alias("last_login"))


# -- X10, X16, X19, X20, X23, X24, X25, X27, X29, J8 --------------------------------------------

@query("pseudonymise_users", with_views("""
    SELECT id, sha256('user:' || CAST(id AS VARCHAR)) AS pseudo_id, sha256(username) = password_hash AS hash_ok
    FROM usr""", "usr"))
def pseudonymise_users(t):
    """SHA-256 pseudonyms; the stored hash equals SHA-256 of the name."""
    return t.users.select("id", X.pseudonym(F.col("id")).alias("pseudo_id"),
                          (F.sha2(F.col("username"), 256) == F.col("password_hash")).alias("hash_ok"))


@query("age_labels", with_views("""
    SELECT id, CASE WHEN mins < 1 THEN 'just now' WHEN mins < 60 THEN CAST(mins AS VARCHAR) || 'm ago'
                    WHEN hrs < 24 THEN CAST(hrs AS VARCHAR) || 'h ago'
                    ELSE CAST(CAST(floor(hrs / 24) AS BIGINT) AS VARCHAR) || 'd ago' END AS age
    FROM (SELECT id, mins, CAST(floor(mins / 60) AS BIGINT) AS hrs
          FROM (SELECT id, CAST(floor((epoch_ms((SELECT max(created_at) FROM ev)) - epoch_ms(created_at)) / 60000) AS BIGINT)
                           AS mins FROM ev))""", "ev"))
def age_labels(t):
    """Relative age of every event, as of the newest event."""
    as_of = t.events.select(F.max("created_at")).scalar()
    return t.events.select("id", X.age_label(F.col("created_at"), as_of).alias("age"))


@query("date_shift", with_views("""
    SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS iso,
           created_at - INTERVAL 2 HOUR AS two_hours_before, strftime(CAST(created_at AS DATE), '%m-%d') AS day_label
    FROM ev""", "ev"))
def date_shift(t):
    """X29 ISO text and interval shift, X20 month-day label."""
    e = t.events
    return e.select("id", X.iso_text(F.col("created_at")).alias("iso"),
                    X.shift_hours(F.col("created_at"), -2).alias("two_hours_before"),
                    X.month_day(F.to_date("created_at")).alias("day_label"))


@query("request_ids", with_views("""
    SELECT id, substring(sha256(CAST(conversation_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR)), 1, 8) AS request_id
    FROM msg""", "msg"))
def request_ids(t):
    """Deterministic short request ids."""
    from parley.functions.text import short_id
    return t.messages.select("id", short_id("conversation_id", "turn").alias("request_id"))


def _escape_sql(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("escaped_text", with_views(f"SELECT id, {_escape_sql('content')} AS html FROM reply_msg", "reply_msg"))
def escaped_text(t):
    """HTML escape of every assistant reply."""
    from parley.functions.text import html_escape
    return t.assistant_replies.select("id", html_escape(F.col("content")).alias("html"))


def _markdown_sql():
    x = _escape_sql("content")
    for pat, rep in X.MARKDOWN_RULES:
        rep2 = rep.replace("$1", "\\1").replace("$2", "\\2")
        x = f"regexp_replace({x}, {lit(pat)}, {lit(rep2)}, 'g')"
    return with_views(f"SELECT id, CASE WHEN content IS NULL OR content = '' THEN '' ELSE {x} END AS html "
                      f"FROM reply_msg", "reply_msg")


@query("markdown_html", _markdown_sql())
def markdown_html(t):
    """Markdown -> HTML of every assistant reply (after X24)."""
    return t.assistant_replies.select("id", X.markdown_html(F.col("content")).alias("html"))


@query("display_labels", with_views(f"""
    SELECT agent_type, COALESCE({SR.map_case('agent_type', AGENT_LABELS)}, agent_type) AS label, count,
           CAST(floor(count / sum(count) OVER () * 100 + 0.5) AS BIGINT) AS pct,
           CAST(CAST(floor(count / sum(count) OVER () * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS pct_label
    FROM qba""", "ev", extra=[("qba", """
    SELECT agent_type, count(*) AS count FROM ev
    WHERE event_type = 'query' AND agent_type IS NOT NULL GROUP BY agent_type""")]))
def display_labels(t):
    """J8 agent display label, X16 half-up rounding, X27 percent label."""
    q = D.queries_by_agent(t.events)
    from pyspark.sql.window import Window as W
    pct = X.round_half_up(F.col("count") / F.sum("count").over(W.partitionBy()) * 100).cast("long")
    return q.select("agent_type", agent_label(F.col("agent_type")).alias("label"), "count",
                    pct.alias("pct"), X.percent_label(pct).alias("pct_label"))


# -- J9, J10 ---------------------------------------------------------------------------------------------

@query("keyword_rule_join", with_views(f"""
    SELECT id, {SR.intent_pick()} AS intent FROM (SELECT id, {SR.intent_scores('t')} FROM gn)""", "gn"))
def keyword_rule_join(t):
    """Keyword intent as a join of every message with a rule table.

    The rules (label, keyword, weight, ordinal) are the fixed catalog, so they
    are literal arrays in the row: the theta join is an ``aggregate`` over
    them that sums the matches per label, and the arg-max keeps the catalog's
    tie order.  No join node, no exchange.
    """
    rules = lambda kws: F.array(*[F.struct(F.lit(kw).alias("keyword"), F.lit(intent_weight(kw)).alias("weight")) for kw in kws])
    matched = lambda total, r: total + F.when(F.contains(F.col("_t"), r["keyword"]), r["weight"]).otherwise(0)
    scored = [F.struct(F.aggregate(rules(kws), F.lit(0), matched).alias("score"), F.lit(-i).alias("o"), F.lit(lbl).alias("label"))
              for i, (lbl, kws) in enumerate(R.intent_keywords)]
    # the label of a message without any keyword wins only over scores of 0
    none = F.struct(F.lit(0).alias("score"), F.lit(1).alias("o"), F.lit("course").alias("label"))
    return t.user_queries.select("id", F.array_max(F.array(*scored, none))["label"].alias("intent"))


@query("keyword_rule_table", ORACLE["keyword_rule_join"])
def keyword_rule_table(t):
    """J9 with the rules as a table: candidates by each keyword's rarest gram,
    then verification; the same intents as I1."""
    rules = [(i * 1000 + j, kw, label, intent_weight(kw), i) for i, (label, kws) in enumerate(R.intent_keywords) for j, kw in enumerate(kws)]
    table = t.spark.createDataFrame(rules, "rule_id long, keyword string, label string, weight int, place int")
    found = label_by_rules(t.user_queries.select("id", F.col("_t").alias("text")), table, "course")
    return found.select("id", F.col("label").alias("intent"))


@query("request_latency", with_views("""
    SELECT s.request_id, b.at AS started_at, s.at AS stopped_at, epoch_ms(s.at) - epoch_ms(b.at) AS elapsed_ms
    FROM (SELECT * FROM marks WHERE mark = 'stop') s
    LEFT JOIN (SELECT * FROM marks WHERE mark = 'start') b ON b.request_id = s.request_id""", "marks"))
def request_latency_q(t):
    """Elapsed ms per stopped request (NULL without a start)."""
    return request_latency(driver.request_marks(t.spark, t.sf_dir))
