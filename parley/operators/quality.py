"""Data-quality checks and request validation.

Every check is a whole-table aggregate or an anti-join: nothing is
collected to the driver and no group is gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions.text import strip_ws


def _rows(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_report(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """F12 NOT NULL: one aggregate over the table, then one row per column."""
    agg = df.agg(*[F.count(F.when(F.col(c).isNull(), F.lit(1))).alias(c) for c in columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    return agg.select(F.lit(table).alias("table_name"), F.lit("not_null").alias("check_name"),
                      F.expr(f"stack({len(columns)}, {stack}) AS (column_name, violations)"))


def unique_report(df: DataFrame, table: str, column: str) -> DataFrame:
    """F12 UNIQUE: number of key values held by more than one row.

    ``groupBy(key).count()`` is a partial aggregate: a hot key is counted
    map-side, the shuffle carries one row per key per task.
    """
    dup = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return dup.agg(F.count(F.lit(1)).alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit("unique").alias("check_name"),
        F.lit(column).alias("column_name"), F.col("violations"))


def constraint_report(tables: dict[str, DataFrame], not_null: dict[str, list[str]],
                      unique: dict[str, list[str]]) -> DataFrame:
    parts = [null_report(tables[t], t, cols) for t, cols in not_null.items()]
    parts += [unique_report(tables[t], t, c) for t, cols in unique.items() for c in cols]
    return _rows(*parts)


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Child rows whose (non-NULL) reference has no parent (``left_anti``)."""
    p = parent.select(F.col(key).alias("_pk"))
    return child.where(F.col(column).isNotNull()).join(p, F.col(column) == F.col("_pk"), "left_anti")


def orphan_counts(checks: list[tuple[str, DataFrame, str, str, DataFrame]]) -> DataFrame:
    """J2 report: (child, column, parent, orphans) for each foreign key."""
    parts = [orphans(c, col, p).agg(F.count(F.lit(1)).alias("orphans")).select(
        F.lit(cn).alias("child"), F.lit(col).alias("column_name"), F.lit(pn).alias("parent"), "orphans")
        for cn, c, col, pn, p in checks]
    return _rows(*parts)


def registration(requests: DataFrame, existing: DataFrame, min_password: int = 6) -> DataFrame:
    """Validate sign-up requests in arrival order.

    Fields are stripped; all of username, password, display name are
    required; the password needs ``min_password`` characters; a username
    already registered -- before, or by an earlier accepted request -- is
    taken.  Among valid requests the first per username (by request_id,
    copy) is accepted: a ``min(struct)`` partial aggregate plus an equi-join
    on the username, rather than a window over a possibly hot username.
    """
    r = requests.select(
        "request_id", "copy",
        strip_ws(F.col("username")).alias("username"), strip_ws(F.col("password")).alias("password"),
        strip_ws(F.col("display_name")).alias("display_name"), strip_ws(F.col("email")).alias("email"))
    size = lambda c: F.coalesce(F.length(c), F.lit(0))  # noqa: E731  (a missing field counts as blank)
    missing = (size("username") == 0) | (size("password") == 0) | (size("display_name") == 0)
    short = size("password") < min_password
    r = r.withColumn("status0", F.when(missing, "missing_fields").when(short, "short_password"))
    ex = existing.select(F.col("username").alias("_u")).distinct()
    valid = r.where(F.col("status0").isNull())
    fresh = valid.join(ex, valid["username"] == ex["_u"], "left_anti")
    first = fresh.groupBy(F.col("username").alias("_fu")).agg(
        F.min(F.struct("request_id", "copy")).alias("_first"))
    j = r.join(first, r["username"] == first["_fu"], "left")
    is_first = (F.col("_first.request_id") == F.col("request_id")) & (F.col("_first.copy") == F.col("copy"))
    status = F.coalesce(F.col("status0"), F.when(is_first, F.lit("accepted")).otherwise(F.lit("username_taken")))
    return j.select("request_id", "copy", "username", status.alias("status"),
                    F.when(status == "accepted", F.sha2(F.col("password"), 256)).alias("password_hash"))


def ticket_intake(requests: DataFrame) -> DataFrame:
    """Category defaults to ``general``; subject and
    description are stripped; a blank subject is rejected."""
    subject = strip_ws(F.col("subject"))
    return requests.select(
        "request_id", "user_id",
        F.coalesce(F.col("category"), F.lit("general")).alias("category"),
        subject.alias("subject"),
        strip_ws(F.coalesce(F.col("description"), F.lit(""))).alias("description"),
        (F.coalesce(F.length(subject), F.lit(0)) > 0).alias("accepted"),
        F.lit("open").alias("status"), F.lit("medium").alias("priority"), "created_at",
    )


def manual_escalations(requests: DataFrame) -> DataFrame:
    """Conversation 0 when none is given, reason ``student_request``,
    the default summary, always high priority."""
    return requests.select(
        "request_id",
        F.coalesce(F.col("conversation_id"), F.lit(0).cast("long")).alias("conversation_id"),
        "user_id",
        F.coalesce(F.col("reason"), F.lit("student_request")).alias("reason"),
        F.coalesce(F.col("summary"), F.lit("Student requested escalation")).alias("summary"),
        F.lit("high").alias("priority"), F.lit("pending").alias("status"), "created_at",
    )
