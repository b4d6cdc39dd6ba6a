"""Operations dashboard: counts, rates, trend, feeds.

Plan shape
----------
* The scalar metrics of several tables come from ONE global aggregate
  over a union of narrow projections (each table tagged by a ``src``
  literal), so there is no join of 1-row frames and every partition
  pre-aggregates before the single-row final merge.
* Group-bys on low-cardinality keys (agent type, day) are partial
  aggregates: the shuffle carries one row per key per map task.
* Feeds are ``orderBy(...).limit(n)`` -> ``TakeOrderedAndProject``
  (per-task top-n, then a merge of n x tasks rows); every sort has an id
  tiebreak so the result is deterministic.
* Per-group top-n uses ``row_number() <= n``; Spark plans a partial
  ``WindowGroupLimit`` before the exchange, so a hot group ships at most
  n rows per map task.
* Global windows (shares, bar heights) run only after aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.operators.ranking import number_rows


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


# -- A1-A8, A3, A4, A12, A13 ---------------------------------------------------

def metric_inputs(events: DataFrame, escalations: DataFrame, violations: DataFrame,
                  tickets: DataFrame, users: DataFrame) -> DataFrame:
    """Union of the narrow columns each metric needs, tagged by source."""
    parts = [
        events.select(F.lit("ev").alias("src"), "event_type", F.col("response_time_ms").cast("long").alias("rt")),
        escalations.select(F.lit("es").alias("src")),
        violations.select(F.lit("vi").alias("src")),
        tickets.select(F.lit("tk").alias("src"), F.col("status")),
        users.select(F.lit("us").alias("src"), F.col("role")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def totals(events: DataFrame, escalations: DataFrame, violations: DataFrame,
           tickets: DataFrame, users: DataFrame) -> DataFrame:
    """One row: the eight counters of the dashboard plus the two raw inputs
    of the rate (A1, A2, A5-A8; escalation events; avg response)."""
    src = F.col("src")
    u = metric_inputs(events, escalations, violations, tickets, users)
    return u.agg(
        _count_if((src == "ev") & (F.col("event_type") == "query")).alias("total_queries"),
        _count_if(src == "es").alias("total_escalations"),
        _count_if((src == "ev") & (F.col("event_type") == "escalation")).alias("escalation_events"),
        F.avg(F.when(src == "ev", F.col("rt"))).alias("avg_rt"),
        _count_if(src == "vi").alias("total_violations"),
        _count_if((src == "tk") & (F.col("status") != "resolved")).alias("open_tickets"),
        _count_if((src == "us") & (F.col("role") == "student")).alias("total_students"),
        _count_if((src == "tk") & (F.col("status") == "resolved")).alias("resolved_tickets"),
    )


def escalation_rate(esc_events: Column, queries: Column) -> Column:
    """A3: round-half-even(esc / max(queries, 1) * 100, 1)."""
    return F.bround(esc_events / F.greatest(queries, F.lit(1)) * 100, 1)


def satisfaction(rate: Column, violations: Column) -> Column:
    """clamp(100 - 2 * rate - 3 * violations, 0, 100)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - rate * 2 - violations * 3))


def avg_response(avg_rt: Column) -> Column:
    """A4: integer half-even round of the mean, 0 when there is none."""
    return F.coalesce(F.bround(avg_rt, 0).cast("long"), F.lit(0).cast("long"))


def snapshot_scalars(events, escalations, violations, tickets, users) -> DataFrame:
    t = totals(events, escalations, violations, tickets, users)
    rate = escalation_rate(F.col("escalation_events"), F.col("total_queries"))
    return t.select(
        "total_queries", "total_escalations",
        rate.alias("escalation_rate"),
        avg_response(F.col("avg_rt")).alias("avg_response_time_ms"),
        "total_violations", "open_tickets", "total_students", "resolved_tickets",
        satisfaction(rate, F.col("total_violations")).alias("satisfaction_score"),
    )


# -- A9, A10, A19, W5 ------------------------------------------------------------

def queries_by_agent(events: DataFrame) -> DataFrame:
    """Query events per agent type (NULL agent excluded)."""
    return (events.where((F.col("event_type") == "query") & F.col("agent_type").isNotNull())
            .groupBy("agent_type").agg(F.count(F.lit(1)).alias("count")))


def agent_map(events: DataFrame) -> DataFrame:
    """A10: the per-agent counts as one map column (bounded: one entry per agent)."""
    return queries_by_agent(events).agg(
        F.map_from_entries(F.collect_list(F.struct("agent_type", "count"))).alias("queries_by_agent"))


def agent_share(events: DataFrame) -> DataFrame:
    """Share of each agent in all routed queries (global window after agg)."""
    q = queries_by_agent(events)
    share = F.col("count") / F.sum("count").over(W.partitionBy())
    return q.select("agent_type", "count", F.round(share, 6).alias("share"))


def bar_heights(counts: DataFrame, value: str = "count", key: str = "agent_type", px: int = 160) -> DataFrame:
    """Value / max(max(all values), 1) * px, after aggregation."""
    h = F.col(value) / F.greatest(F.max(value).over(W.partitionBy()), F.lit(1)) * px
    return counts.select(key, value, F.round(h, 6).alias("height_px"))


# -- A11, O9 ---------------------------------------------------------------------

def response_trend(events: DataFrame, days: int = 7) -> DataFrame:
    """Per day avg and count of timed events; latest ``days`` days with data."""
    daily = (events.where(F.col("response_time_ms").isNotNull())
             .groupBy(F.to_date("created_at").alias("date"))
             .agg(F.avg("response_time_ms").alias("avg_time"), F.count(F.lit(1)).alias("count")))
    return daily.orderBy(F.col("date").desc()).limit(days).select(
        "date", "avg_time", "count", F.date_format("date", "MM-dd").alias("label"))


# -- feeds O1-O8, O10, J1 -----------------------------------------------------------

def newest(df: DataFrame, n: int, ts: str = "created_at", key: str = "id") -> DataFrame:
    """The ``n`` newest rows (``TakeOrderedAndProject``), id as tiebreak."""
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n)


def recent_escalations(escalations: DataFrame, users: DataFrame, n: int = 20) -> DataFrame:
    """Escalations joined to the user's display name, newest ``n``.

    Inner equi-join on the users primary key.  The users side is projected
    to (id, display_name); Catalyst broadcasts it only when its estimated
    size is under ``autoBroadcastJoinThreshold`` and AQE re-checks the real
    size at run time, otherwise both sides are shuffled on the key.
    """
    u = users.select(F.col("id").alias("u_id"), "display_name")
    j = escalations.join(u, escalations["user_id"] == u["u_id"], "inner").drop("u_id")
    return newest(j, n)


def top_n_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..n within each group (partial group limit before shuffle)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w).cast("long")).where(F.col(rank_col) <= n)


def recent_conversations(conversations: DataFrame, n: int = 20, shown: int = 5) -> DataFrame:
    """Each user's ``n`` most recently updated conversations; the
    first ``shown`` are flagged as displayed on the home page."""
    r = top_n_per_group(conversations, ["user_id"], [F.col("updated_at").desc(), F.col("id").desc()], n)
    return r.withColumn("shown", F.col("rank") <= shown)


def visible_tickets(tickets: DataFrame, viewer_id: Column, viewer_role: Column) -> DataFrame:
    """F9/O3 for one viewer, newest first: an admin sees every ticket, anyone
    else only their own."""
    seen = tickets.where((viewer_role == F.lit("admin")) | (F.col("user_id") == viewer_id))
    return seen.orderBy(F.col("created_at").desc(), F.col("id").desc())


def ticket_listing(tickets: DataFrame, partitions: int | None = None) -> DataFrame:
    """F9/O3 for all viewers: every listing there is, newest first.

    ``listing = 'all'`` is the one listing all admins share; ``'own'`` has one
    listing per user.  ``position`` counts from 0 within a listing; both use
    :func:`number_rows`, so neither the whole table nor a user with a third of
    all tickets is sorted in one task.
    """
    t = tickets.select("user_id", "id", "category", "subject", "status", "priority", "created_at")
    order = [F.col("created_at").desc(), F.col("id").desc()]
    everything = number_rows(t, [], order, "position", partitions).withColumn("listing", F.lit("all"))
    own = number_rows(t, ["user_id"], order, "position", partitions).withColumn("listing", F.lit("own"))
    return everything.unionByName(own)


def oldest_first(df: DataFrame, ts: str = "created_at", key: str = "id") -> DataFrame:
    """A bounded newest-n feed shown oldest first, with ``position``."""
    w = W.orderBy(F.col(ts), F.col(key))
    return df.withColumn("position", (F.row_number().over(w) - 1).cast("long")).orderBy("position")


def courses_sorted(courses: DataFrame) -> DataFrame:
    """Courses by title (binary collation), id as tiebreak."""
    return courses.orderBy("title", "id")


def ticket_visibility(tickets: DataFrame, users: DataFrame) -> DataFrame:
    """F9 for every viewer as (count, newest) of the tickets they can see.

    Own tickets: a partial aggregate per user joined to users on the key.
    The admin figures are two scalar subqueries over the whole table
    (single-row aggregates), not a product of admins and tickets.
    """
    own = tickets.groupBy(F.col("user_id").alias("o_user")).agg(
        F.count(F.lit(1)).alias("n"), F.max("created_at").alias("newest"))
    everything = tickets.select(F.struct(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("newest"))).scalar()
    n_all, newest_all = everything["n"], everything["newest"]
    u = users.select(F.col("id").alias("user_id"), "role")
    j = u.join(own, u["user_id"] == own["o_user"], "left")
    admin = F.col("role") == "admin"
    return j.select(
        "user_id", "role",
        F.when(admin, n_all).otherwise(F.coalesce(F.col("n"), F.lit(0))).alias("visible_tickets"),
        F.when(admin, newest_all).otherwise(F.col("newest")).alias("newest_ticket_at"),
    )


def dashboard_record(events: DataFrame, escalations: DataFrame, violations: DataFrame,
                     tickets: DataFrame, users: DataFrame) -> DataFrame:
    """The whole dashboard as one row of 13 keys (9 scalars, the per-agent
    map, the 20 newest events, the 10 newest violations and the 7-day trend,
    oldest day first).

    Every nested value is bounded (one entry per agent, 20 / 10 / 7 rows)
    and comes from a scalar subquery over its own plan, so no unbounded
    group is collected and no frames are cross-joined.
    """
    snap = snapshot_scalars(events, escalations, violations, tickets, users)
    agents = agent_map(events).select("queries_by_agent").scalar()
    rows = lambda df, cols, asc: df.agg(F.sort_array(F.collect_list(F.struct(*cols)), asc=asc).alias("v")).select("v").scalar()
    ev = rows(newest(events, 20), ["created_at", "id", "event_type", "user_id", "agent_type", "response_time_ms"], False)
    vi = rows(newest(violations, 10), ["created_at", "id", "user_id", "violation_type", "original_query", "action_taken", "severity"], False)
    tr = rows(response_trend(events), ["date", "avg_time", "count"], True)
    return snap.select("*", F.coalesce(agents, F.create_map().cast("map<string,bigint>")).alias("queries_by_agent"),
                       ev.alias("recent_events"), vi.alias("recent_violations"), tr.alias("response_time_trend"))


def record_rows(record: DataFrame) -> DataFrame:
    """The record as (key, position, value) rows, for reports and checks.

    Lists keep their order in ``position``; values are text, numbers with
    three decimals.
    """
    num = lambda c: c.cast("decimal(38,3)").cast("string")
    ts = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    scalars = [c for c in record.columns if c not in ("queries_by_agent", "recent_events", "recent_violations", "response_time_trend")]
    one = [F.array(F.struct(F.lit(c).alias("key"), F.lit(0).alias("position"), num(F.col(c)).alias("value"))) for c in scalars]
    listed = lambda key, column, show: F.transform(column, lambda x, i: F.struct(F.lit(key).alias("key"), i.alias("position"), show(x).alias("value")))
    agents = F.sort_array(F.map_entries("queries_by_agent"))
    parts = one + [
        listed("queries_by_agent", agents, lambda x: F.concat_ws("|", x["key"], num(x["value"]))),
        listed("recent_events", F.col("recent_events"), lambda x: F.concat_ws("|", ts(x["created_at"]), x["id"].cast("string"), x["event_type"], x["agent_type"])),
        listed("recent_violations", F.col("recent_violations"), lambda x: F.concat_ws("|", ts(x["created_at"]), x["id"].cast("string"), x["violation_type"], x["severity"])),
        listed("response_time_trend", F.col("response_time_trend"), lambda x: F.concat_ws("|", x["date"].cast("string"), num(x["avg_time"]), num(x["count"]))),
    ]
    rows = record.select(F.explode(F.flatten(F.array(*parts))).alias("r")).select("r.*")
    return rows.withColumn("position", F.col("position").cast("long"))
