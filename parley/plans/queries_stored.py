"""Queries over stored tables that change (S8, S10, S11, S12, J2, F12): each
writes its tables under the shared folder batch by batch, with a replay, and
returns what is stored in the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.text import strip_ws
from parley.operators import quality as Q
from parley.plans import pipeline as P
from parley.plans import queries_misc  # noqa: F401  (its registration SQL is used again)
from parley.plans.catalog import ORACLE, query
from parley.plans.sql import with_views
from parley.session import materialize
from parley.sources import driver
from parley.sources import stored as T
from parley.streaming import bounded as B
from parley.streaming import core as S


@query("stored_conversation_state", with_views("""
    SELECT conversation_id, arg_max(agent_type, turn) AS agent_type, max(created_at) AS updated_at
    FROM dec GROUP BY conversation_id""", "dec"))
def stored_conversation_state(t):
    """Two change sets of conversation states, the older one replayed after
    the newer, merged into a stored table bucket by bucket."""
    decided = materialize(t.decisions.select("conversation_id", "turn", "agent_type", "created_at"))
    table = T.KeyedTable(t.spark, S.new_base(t.spark, "conversation-state"), "conversation_id", buckets=16)
    state = lambda rows: P.conversation_state(rows).drop("n_decisions")
    early, late = state(decided.where("turn < 4")), state(decided.where("turn >= 4"))
    for changes in (early, late, early):
        table.upsert(changes, "updated_at")
    return table.read().select("conversation_id", "agent_type", "updated_at")


@query("stored_last_login", with_views("""
    SELECT u.id, u.username, u.role, a.last_login
    FROM usr u LEFT JOIN (SELECT user_id, max(created_at) AS last_login FROM ev GROUP BY user_id) a ON a.user_id = u.id""", "usr", "ev"))
def stored_last_login(t):
    """Stored users whose last_login a stream of events updates."""
    base = S.new_base(t.spark, "last-login")
    table = T.KeyedTable(t.spark, f"{base}/users", "id", buckets=16)
    table.create(t.users)
    B.last_logins(driver.map_events(S.table_stream(t.spark, t.sf_dir, "events")), table, base)
    return table.read().select("id", "username", "role", "last_login")


@query("stored_tickets", with_views("""
    SELECT CAST(0 AS INTEGER) AS batch_id, request_id, category, subject,
           CASE WHEN subject = '' THEN 'blank_subject' WHEN NOT student THEN 'unknown_student' END AS reason
    FROM r WHERE created_at < TIMESTAMP '1995-06-01'
    UNION ALL
    SELECT 1, request_id, category, subject,
           CASE WHEN subject = '' THEN 'blank_subject' WHEN NOT student THEN 'unknown_student'
                WHEN created_at < TIMESTAMP '1995-06-01' THEN 'duplicate_request' END
    FROM r""", "tkt_req", "usr", extra=[("r", """
    SELECT request_id, COALESCE(category, 'general') AS category, trim(subject) AS subject, created_at,
           user_id IN (SELECT id FROM usr WHERE role = 'student') AS student FROM tkt_req""")]))
def stored_tickets(t):
    """S8 / J2 / F12 at the write: tickets of two batches, where the second
    delivers the first again, and the first is replayed at the end.  Accepted and
    rejected rows (with their reason) make up both batches."""
    requests = Q.ticket_intake(driver.ticket_requests(t.spark, t.sf_dir)).drop("accepted")
    rules = T.Constraints(
        checks=[("blank_subject", F.length("subject") > 0), *T.not_null(["user_id", "category"])],
        references=[("unknown_student", "user_id", t.users.where("role = 'student'"), "id")],
        unique="request_id", unique_reason="duplicate_request", order=["created_at"])
    base = S.new_base(t.spark, "tickets")
    first = requests.where(F.col("created_at") < F.lit("1995-06-01").cast("timestamp_ntz"))
    for batch_id, batch in ((0, first), (1, requests), (0, first)):
        T.append_checked(batch, batch_id, base, rules)
    columns = ["batch_id", "request_id", "category", "subject"]
    accepted, rejected = (t.spark.read.parquet(f"{base}/{n}") for n in ("accepted", "rejected"))
    return accepted.select(*columns, F.lit(None).cast("string").alias("reason")).unionByName(rejected.select(*columns, "reason"))


@query("stored_registrations", ORACLE["registration_accept"])
def stored_registrations(t):
    """S12 at the write: the sign-ups of two batches; the users that are stored
    after the first make their names taken in the second."""
    r = driver.registration_requests(t.spark, t.sf_dir)
    names = ("username", "password", "display_name")
    r = r.select("request_id", "copy", *[strip_ws(F.col(c)).alias(c) for c in names])
    filled = F.lit(True)
    for c in names:
        filled = filled & (F.coalesce(F.length(c), F.lit(0)) > 0)
    rules = T.Constraints(
        checks=[("missing_fields", filled), ("short_password", F.length("password") >= 6)],
        unique="username", unique_reason="username_taken", order=["request_id", "copy"],
        taken=driver.existing_users(t.spark, t.sf_dir))
    base = S.new_base(t.spark, "registrations")
    middle = r.agg(F.percentile_approx("request_id", 0.75)).first()[0]
    user = lambda rows: rows.select("request_id", "copy", "username", F.sha2("password", 256).alias("password_hash"))
    first, second = r.where(F.col("request_id") < middle), r.where(F.col("request_id") >= middle)
    for batch_id, batch in ((0, first), (1, second), (1, second)):
        T.append_checked(batch, batch_id, base, rules, store=user)
    accepted = t.spark.read.parquet(f"{base}/accepted").withColumn("status", F.lit("accepted"))
    rejected = t.spark.read.parquet(f"{base}/rejected").select(
        "request_id", "copy", "username", F.lit(None).cast("string").alias("password_hash"), F.col("reason").alias("status"))
    return accepted.select(*rejected.columns).unionByName(rejected)
