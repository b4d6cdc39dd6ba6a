"""Declared schemas of the support-platform tables, and their defaults.

Types follow the relational model: integer ids are ``bigint``, text is
``string``, times are ``timestamp_ntz`` (wall-clock, as written by the
application).  JSON-in-text columns (``enrolled_courses``, ``modules``,
``metadata``) stay strings at rest and are parsed with ``from_json`` on
read (see :mod:`parley.functions.text`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, S, TS = T.LongType(), T.StringType(), T.TimestampNTZType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in cols])


USERS = _schema(
    ("id", L, False), ("username", S, False), ("password_hash", S, False), ("display_name", S, False),
    ("email", S, True), ("role", S, False), ("enrolled_courses", S, True), ("created_at", TS, True),
    ("last_login", TS, True),
)
CONVERSATIONS = _schema(
    ("id", L, False), ("user_id", L, False), ("agent_type", S, False), ("title", S, True),
    ("status", S, True), ("created_at", TS, True), ("updated_at", TS, True),
)
MESSAGES = _schema(
    ("id", L, False), ("conversation_id", L, False), ("role", S, False), ("content", S, False),
    ("agent_type", S, True), ("metadata", S, True), ("created_at", TS, True),
)
SUPPORT_TICKETS = _schema(
    ("id", L, False), ("user_id", L, False), ("category", S, False), ("subject", S, False),
    ("description", S, True), ("status", S, True), ("priority", S, True), ("resolution", S, True),
    ("created_at", TS, True), ("resolved_at", TS, True),
)
ESCALATIONS = _schema(
    ("id", L, False), ("conversation_id", L, False), ("user_id", L, False), ("reason", S, False),
    ("summary", S, True), ("priority", S, True), ("status", S, True), ("assigned_to", S, True),
    ("created_at", TS, True), ("resolved_at", TS, True),
)
ANALYTICS_EVENTS = _schema(
    ("id", L, False), ("event_type", S, False), ("user_id", L, True), ("agent_type", S, True),
    ("metadata", S, True), ("response_time_ms", L, True), ("created_at", TS, True),
)
GUARDRAIL_VIOLATIONS = _schema(
    ("id", L, False), ("user_id", L, True), ("violation_type", S, False), ("original_query", S, True),
    ("action_taken", S, False), ("severity", S, True), ("created_at", TS, True),
)
COURSES = _schema(
    ("id", L, False), ("title", S, False), ("description", S, True), ("instructor", S, True),
    ("category", S, True), ("difficulty", S, True), ("modules", S, True), ("created_at", TS, True),
)

SCHEMAS: dict[str, T.StructType] = {
    "users": USERS,
    "conversations": CONVERSATIONS,
    "messages": MESSAGES,
    "support_tickets": SUPPORT_TICKETS,
    "escalations": ESCALATIONS,
    "analytics_events": ANALYTICS_EVENTS,
    "guardrail_violations": GUARDRAIL_VIOLATIONS,
    "courses": COURSES,
}

# Column defaults of the relational model. ``NOW`` means the load time.
NOW = object()
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"role": "student", "enrolled_courses": "[]", "created_at": NOW},
    "conversations": {"agent_type": "orchestrator", "status": "active", "created_at": NOW, "updated_at": NOW},
    "messages": {"metadata": "{}", "created_at": NOW},
    "support_tickets": {"status": "open", "priority": "medium", "created_at": NOW},
    "escalations": {"priority": "medium", "status": "pending", "created_at": NOW},
    "analytics_events": {"metadata": "{}", "created_at": NOW},
    "guardrail_violations": {"severity": "medium", "created_at": NOW},
    "courses": {"difficulty": "intermediate", "modules": "[]", "created_at": NOW},
}

# Foreign keys: (child table, child column, parent table, parent column)
FOREIGN_KEYS = [
    ("conversations", "user_id", "users", "id"),
    ("messages", "conversation_id", "conversations", "id"),
    ("support_tickets", "user_id", "users", "id"),
    ("escalations", "conversation_id", "conversations", "id"),
    ("escalations", "user_id", "users", "id"),
]

UNIQUE_KEYS = {"users": [["id"], ["username"]]}


def not_null_columns(table: str) -> list[str]:
    return [f.name for f in SCHEMAS[table].fields if not f.nullable]


def with_defaults(df: DataFrame, table: str, now: Column | None = None) -> DataFrame:
    """Project ``df`` onto the declared schema, filling defaults.

    Missing columns are added (default or NULL); present NULLs take the
    default, like an INSERT that omits the column.  Narrow projection only.
    """
    now = now if now is not None else F.localtimestamp()
    cols = []
    for f in SCHEMAS[table].fields:
        default = DEFAULTS[table].get(f.name)
        if default is NOW:
            dflt = now.cast(f.dataType)
        elif default is not None:
            dflt = F.lit(default).cast(f.dataType)
        else:
            dflt = F.lit(None).cast(f.dataType)
        if f.name in df.columns:
            c = F.col(f.name).cast(f.dataType)
            c = F.coalesce(c, dflt) if default is not None else c
        else:
            c = dflt
        cols.append(c.alias(f.name))
    return df.select(*cols)
