"""Flagship flow: messages -> decisions -> derived tables -> dashboard.

The decisions are the expensive step (every rule over every user message
plus one context shuffle).  Three tables read them, so they are
materialised once with a reliable checkpoint in the shared checkpoint
folder; the derived tables and the dashboard then read plain columns
(cheap filters, no re-evaluation, lineage cut for executor loss).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.plans import dashboard as D
from parley.plans import pipeline as P
from parley.plans.views import Tables
from parley.session import materialize


def derived_tables(t: Tables, materialized: bool = True) -> dict[str, DataFrame]:
    dec = P.classify_messages(t.chat_messages)
    if materialized:
        dec = materialize(dec)
    return {
        "decisions": dec,
        "events": P.events_from(dec),
        "violations": P.violations_from(dec),
        "escalations": P.escalations_from(dec),
    }


def pipeline_dashboard(t: Tables, materialized: bool = True) -> DataFrame:
    d = derived_tables(t, materialized)
    return D.snapshot_scalars(d["events"], d["escalations"], d["violations"], t.tickets, t.users)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline_dashboard(Tables(spark, sf_dir))
