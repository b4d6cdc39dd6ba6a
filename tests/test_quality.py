"""Quality checks, registration, sinks, presentation."""

import glob

import pytest
from pyspark.sql import functions as F

from parley.functions import present as X
from parley.operators import quality as Q
from parley.sources import sinks
from parley.sources.fixtures import seed


def test_registration_rules(spark):
    req = spark.createDataFrame([
        (1, 0, " alice ", "secret1", "Alice", ""),      # accepted
        (2, 0, "bob", "short", "Bob", ""),              # short password
        (3, 0, "carol", "secret1", "  ", ""),           # missing display name
        (4, 0, "dave", "secret1", "Dave", ""),          # existing user
        (5, 0, "alice", "secret2", "Alice B", ""),      # taken by request 1
        (6, 0, "bob", "longenough", "Bob", ""),         # first valid bob
    ], "request_id long, copy int, username string, password string, display_name string, email string")
    existing = spark.createDataFrame([(9, "dave")], "id long, username string")
    got = {r.request_id: r.status for r in Q.registration(req, existing).collect()}
    assert got == {1: "accepted", 2: "short_password", 3: "missing_fields", 4: "username_taken",
                   5: "username_taken", 6: "accepted"}


def test_constraints_and_orphans(spark):
    s = seed(spark)
    rep = Q.constraint_report({"users": s["users"]}, {"users": ["id", "username"]}, {"users": ["username"]})
    assert all(r.violations == 0 for r in rep.collect())
    tickets = s["support_tickets"].union(s["support_tickets"].limit(1).withColumn("user_id", F.lit(99)))
    o = Q.orphan_counts([("support_tickets", tickets, "user_id", "users", s["users"])]).collect()[0]
    assert o.orphans == 1


def test_sinks_roundtrip(spark, scratch):
    s = seed(spark)
    sinks.log_violations(s["guardrail_violations"], f"{scratch}/v", 0)
    sinks.log_violations(s["guardrail_violations"], f"{scratch}/v", 0)  # a retry leaves one copy
    sinks.load_if_empty(s["users"], f"{scratch}/u")
    sinks.load_if_empty(s["users"].limit(1), f"{scratch}/u")  # ignored: already loaded
    assert spark.read.parquet(f"{scratch}/v").count() == 3
    assert spark.read.parquet(f"{scratch}/u").count() == 5
    j = sinks.json_documents(s["courses"].select("id", "title")).collect()[0][0]
    assert j.startswith('{"id":1,"title":')


@pytest.mark.parametrize("write,columns", [(sinks.log_events, {"event_type": "query"}),
                                           (sinks.log_violations, {"violation_type": "toxicity", "original_query": "q", "action_taken": "blocked"})])
def test_day_folders_are_not_cut_by_task(spark, scratch, write, columns):
    at = lambda day: F.make_timestamp_ntz(F.lit(2024), F.lit(1), 1 + day, F.lit(9), F.lit(0), F.lit(0))
    rows = spark.range(0, 400, 1, 8).select("id", (F.col("id") % 5).alias("user_id"), at((F.col("id") % 5).cast("int")).alias("created_at"),
                                            *[F.lit(v).alias(c) for c, v in columns.items()])
    for _ in range(2):
        write(rows, f"{scratch}/t", 0)
    days = glob.glob(f"{scratch}/t/batch_id=0/event_date=*")
    assert len(days) == 5 and len(glob.glob(f"{scratch}/t/batch_id=0/*/*.parquet")) == 5  # not one from each of 8 tasks
    stored = spark.read.parquet(f"{scratch}/t")
    kept = ["id", "user_id", "created_at", *columns]
    assert sorted(map(tuple, stored.select(*kept).collect())) == sorted(map(tuple, rows.select(*kept).collect()))
    assert stored.where("event_date <> date(created_at)").count() == 0


def test_a_hot_day_is_written_by_several_tasks(spark, scratch):
    rows = spark.range(0, 40_000, 1, 8).select(
        F.col("id"), F.lit("query").alias("event_type"), F.sha2(F.col("id").cast("string"), 256).alias("metadata"),
        F.when(F.col("id") % 100 == 0, F.lit("2024-01-02")).otherwise(F.lit("2024-01-01")).cast("timestamp_ntz").alias("created_at"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "256k")
    try:
        sinks.log_events(rows, f"{scratch}/t", 0)
    finally:
        spark.conf.unset(size)
    hot, cold = (glob.glob(f"{scratch}/t/batch_id=0/event_date=2024-01-0{d}/*.parquet") for d in (1, 2))
    assert len(hot) > 1 and len(cold) == 1
    assert spark.read.parquet(f"{scratch}/t").agg(F.count("id"), F.count_distinct("id")).first() == (40_000, 40_000)


def test_markdown_and_labels(spark):
    df = spark.createDataFrame([("**Key** `x` <b>\n- a\n- b\n### T",)], "t string")
    html = df.select(X.markdown_html("t")).collect()[0][0]
    assert html == ("<strong>Key</strong> <code>x</code> &lt;b&gt;<br><ul><li>a</li><br><li>b</li><br></ul>"
                    "<h3>T</h3>")
    ages = spark.createDataFrame([("2024-01-10 11:59:30",), ("2024-01-10 11:00:00",), ("2024-01-09 10:00:00",),
                                  ("2024-01-01 00:00:00",)], "ts string").select(
        X.age_label(F.col("ts").cast("timestamp_ntz"), F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")))
    assert [r[0] for r in ages.collect()] == ["just now", "1h ago", "1d ago", "9d ago"]


def test_with_defaults_fills_like_an_insert(spark):
    from parley.sources.schemas import with_defaults
    df = spark.createDataFrame([(1, 7, "technical", "subj", None)],
                               "id long, user_id long, category string, subject string, status string")
    r = with_defaults(df, "support_tickets").collect()[0]
    assert (r.status, r.priority, r.description, r.resolved_at) == ("open", "medium", None, None)
    assert r.created_at is not None
    assert [f.name for f in with_defaults(df, "support_tickets").schema.fields][-2:] == ["created_at", "resolved_at"]


def test_request_latency_pairs(spark):
    from parley.operators.latency import request_latency
    marks = spark.createDataFrame([
        (1, "start", "2024-01-01 00:00:00.000"), (1, "stop", "2024-01-01 00:00:01.250"),
        (2, "stop", "2024-01-01 00:00:05.000"),                       # stop without a start
        (3, "start", "2024-01-01 00:00:09.000"),                      # open timer: no row
    ], "request_id long, mark string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    got = {r.request_id: r.elapsed_ms for r in request_latency(marks).collect()}
    assert got == {1: 1250, 2: None}


def test_views_push_filters_and_prune_columns(spark):
    """Mapped views stay narrow: filters reach the Parquet scan and only the
    used columns are read."""
    from tests.conftest import SF001
    from parley.plans.views import Tables
    t = Tables(spark, SF001)
    plan = t.escalations.select("id", "reason")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan
    plan = t.chat_queries.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,user)" in plan and "text" not in plan.split("ReadSchema:")[1].split(">")[0]


def test_list_grouping_matches_regex_and_survives_long_lists(spark):
    """Markdown list grouping equals the regex rule, and a reply with 20,000
    list items no longer overflows the Java regex stack."""
    import re
    from parley.functions.present import _wrap_lists

    def ref(t):
        return re.sub(r"((<li>[^\n\r  ]*</li>\n?)+)", r"<ul>\1</ul>", t)
    cases = ["<li>a</li>\n<li>b</li>\nx", "x <li>a</li> y\n<li>b</li>", "<li>a</li>\n<li>b</li>\n",
             "a\n<li>b</li>\n\n<li>c</li> tail\n<li>d", "<li></li><li>x</li>\n<li>y</li>z\n<li>w</li>\n",
             "<li>a\n</li>", "<li>a</li>\n<li>b</li> t\n<li>c</li>", "", "<li>x</li>\r\n<li>y</li>"]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(_wrap_lists(F.col("t"))).collect()
    assert [g[0] for g in got] == [ref(c) for c in cases]
    long = spark.createDataFrame([("- item\n" * 20000,)], "t string")
    assert long.select(F.length(X.markdown_html("t"))).collect()[0][0] == 340009
