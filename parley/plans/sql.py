"""Oracle SQL (DuckDB dialect) for every registered query.

Written by hand, independently of the DataFrame code: only constants
(phrase banks, keyword lists, rule patterns, reply bodies) are shared, and
rule patterns are adapted to RE2 by :func:`re2`.  The mapped views of
:mod:`parley.sources.driver` appear here as CTEs over the driver tables.
"""

from __future__ import annotations

from parley.sources import driver


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


# -- RE2 adaptation of Python rules --------------------------------------------
# RE2 has no look-around and ASCII \b, \s, \d.  Word boundaries are emulated
# by consuming the neighbouring character and the rule body is captured in
# group 1, which is what the extraction returns.
W = r"\p{L}\p{N}_"
WS = r"\t-\r\x{1c}-\x{1f} \x{85}\p{Z}"


def re2(pattern: str) -> str:
    p = pattern
    p = p.replace(r"\s", f"[{WS}]").replace(r"\d", r"\p{Nd}")
    lead = p.startswith(r"\b")
    trail = p.endswith(r"\b")
    if lead:
        p = p[2:]
    if trail:
        p = p[:-2]
    # a word token, boundary, any run, boundary, a word token
    p = p.replace(r"\b.*\b", f"[^{W}\\n](?:.*[^{W}\\n])?")
    # whitespace run then any run then a boundary before a word token
    p = p.replace(f"[{WS}]+.*\\b", f"[{WS}]+(?:.*[^{W}\\n])?")
    assert r"\b" not in p, pattern
    return (f"(?:^|[^{W}])" if lead else "") + "(" + p + ")" + (f"(?:$|[^{W}])" if trail else "")


# -- mapped views ---------------------------------------------------------------

def _case(col: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + " END"


EPOCH = f"TIMESTAMP {lit(driver.EPOCH)}"

VIEWS: dict[str, str] = {
    "msg": f"""
        SELECT CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR) || '|' || CAST(turn AS VARCHAR)), 1, 15) AS BIGINT) AS id,
               conv_id AS conversation_id, turn, CASE WHEN conv_id % 2 = 0 THEN conv_id // 50 ELSE conv_id END AS user_id,
               role, text AS content, {EPOCH} + to_seconds(conv_id * 3600 + turn * 60) AS created_at
        FROM conversations""",
    "chat_msg": f"""
        SELECT id, conversation_id, turn, user_id, role,
               CASE WHEN role = 'user'
                    THEN {arr(driver.USER_PHRASES)}[((conversation_id * 7 + turn // 4) % {len(driver.USER_PHRASES)}) + 1] || ' ' || content
                    ELSE content END AS content,
               created_at
        FROM msg""",
    "chat_q": "SELECT * FROM chat_msg WHERE role = 'user'",
    "reply_msg": f"""
        SELECT id, conversation_id, turn, user_id, role,
               {arr(driver.REPLY_PHRASES)}[((conversation_id * 5 + turn) % {len(driver.REPLY_PHRASES)}) + 1] || ' ' || content AS content,
               created_at
        FROM msg WHERE role = 'assistant'""",
    "ev": f"""
        SELECT event_id AS id, {_case('event_type', driver.EVENT_TYPE)} AS event_type, user_id,
               CASE WHEN event_type IN ('view', 'click') THEN {arr(driver.AGENTS_BY_USER)}[(user_id % 5) + 1] END AS agent_type,
               props AS metadata,
               CASE WHEN event_type = 'click' THEN CAST(trunc(value * 10) AS BIGINT) END AS response_time_ms,
               ts AS created_at
        FROM events""",
    "usr": f"""
        SELECT c_custkey AS id, c_name AS username, sha256(c_name) AS password_hash, c_name AS display_name,
               lower(replace(c_name, '#', '.')) || '@example.edu' AS email,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'faculty' WHEN 'MACHINERY' THEN 'admin' ELSE 'student' END AS role,
               CASE WHEN c_nationkey % 2 = 0 THEN '["N' || CAST(c_nationkey AS VARCHAR) || '"]' ELSE '[]' END
                   AS enrolled_courses,
               {EPOCH} AS created_at, CAST(NULL AS TIMESTAMP) AS last_login
        FROM customer""",
    "tkt": f"""
        SELECT o_orderkey AS id, o_custkey AS user_id,
               {arr(driver.TICKET_CATEGORIES)}[(o_orderkey % 5) + 1] AS category,
               'Order ' || CAST(o_orderkey AS VARCHAR) AS subject, CAST(NULL AS VARCHAR) AS description,
               CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' END AS status,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high'
                    WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS priority,
               CAST(NULL AS VARCHAR) AS resolution, o_orderdate AS created_at,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END AS resolved_at
        FROM orders""",
    "esc": f"""
        SELECT event_id AS id, user_id AS conversation_id, user_id,
               {arr(driver.ESCALATION_REASONS)}[(event_id % 4) + 1] AS reason, props AS summary,
               CASE WHEN event_id % 4 = 3 THEN 'high' ELSE 'medium' END AS priority,
               CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'pending' END AS status,
               CAST(NULL AS VARCHAR) AS assigned_to, ts AS created_at, CAST(NULL AS TIMESTAMP) AS resolved_at
        FROM events WHERE event_type = 'error'""",
    "crs": f"""
        SELECT p_partkey AS id, p_name AS title, p_type AS description, p_brand AS instructor, p_type AS category,
               CASE WHEN p_size < 17 THEN 'beginner' WHEN p_size < 34 THEN 'intermediate' ELSE 'advanced' END AS difficulty,
               '[]' AS modules, {EPOCH} AS created_at
        FROM part""",
}

VIEWS["doc_reply"] = f"""
        SELECT doc_id, {arr(driver.REPLY_PHRASES)}[(doc_id % {len(driver.REPLY_PHRASES)}) + 1] || ' ' || text AS content
        FROM documents"""
VIEWS["tkt_req"] = f"""
        SELECT o_orderkey AS request_id, o_custkey AS user_id,
               CASE WHEN o_orderkey % 7 != 0 THEN {arr(driver.TICKET_CATEGORIES)}[(o_orderkey % 5) + 1] END AS category,
               CASE WHEN o_orderkey % 13 = 0 THEN '   ' ELSE '  Order ' || CAST(o_orderkey AS VARCHAR) || ' issue ' END
                   AS subject,
               CASE WHEN o_orderkey % 3 != 0 THEN ' status ' || o_orderstatus || chr(10) END AS description,
               o_orderdate AS created_at
        FROM orders"""
VIEWS["esc_req"] = f"""
        SELECT event_id AS request_id, user_id,
               CASE WHEN event_id % 5 != 0 THEN user_id END AS conversation_id,
               CASE WHEN event_id % 3 != 0 THEN {arr(driver.ESCALATION_REASONS)}[(event_id % 4) + 1] END AS reason,
               CASE WHEN event_id % 2 != 0 THEN props END AS summary,
               ts AS created_at
        FROM events WHERE event_type = 'purchase'"""
VIEWS["marks"] = """
        SELECT event_id AS request_id, 'start' AS mark, ts AS at FROM events WHERE NOT (event_id % 17 = 1 AND event_id % 10 != 0)
        UNION ALL
        SELECT event_id, 'stop', ts + to_milliseconds(CAST(trunc(value * 10) AS BIGINT)) FROM events
        WHERE event_id % 10 != 0"""
_REG = """
        SELECT c_custkey AS request_id, '  ' || c_name || ' ' AS username,
               CASE WHEN c_custkey % 17 != 0 THEN repeat('x', 3 + c_custkey % 6) END AS password,
               CASE WHEN c_custkey % 11 = 0 THEN ' ' WHEN c_custkey % 13 != 0 THEN c_name END AS display_name, '' AS email"""
VIEWS["reg_req"] = f"{_REG}, 0 AS copy FROM customer UNION ALL {_REG}, 1 AS copy FROM customer WHERE c_custkey % 7 = 0"
VIEWS["logins"] = """
        SELECT c_custkey AS request_id, CASE WHEN c_custkey % 5 = 0 THEN c_name || '?' ELSE c_name END AS username
        FROM customer"""
VIEWS["reg_existing"] = """
        SELECT c_custkey AS id, c_name AS username FROM customer
        WHERE c_custkey < (SELECT (max(c_custkey) + 1) / 2 FROM customer)"""

# view dependencies (a query lists what it reads; the closure is emitted)
DEPENDS = {"chat_msg": ["msg"], "chat_q": ["chat_msg"], "reply_msg": ["msg"]}


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | tuple = ()) -> str:
    """``WITH`` clause holding the named views (and what they read), then
    the ``extra`` (name, sql) CTEs in order, then ``body``."""
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join([f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra])
    return f"WITH {ctes}\n{body}" if ctes else body


def register_view(name: str, sql: str, depends: list[str] | None = None) -> None:
    VIEWS[name] = sql
    if depends:
        DEPENDS[name] = depends
