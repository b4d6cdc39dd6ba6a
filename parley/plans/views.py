"""Loaded views over one data folder, built lazily and cached per call site.

``Tables(spark, sf_dir)`` hands out the mapped application tables
(:mod:`parley.sources.driver`) and the derived ones (decisions, events,
violations...) so a query names what it needs and Catalyst prunes the
rest.  Nothing is materialised: each property is a lazy DataFrame.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from parley.sources import driver


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    # mapped tables ----------------------------------------------------------
    @cached_property
    def messages(self) -> DataFrame:
        return driver.messages(self.spark, self.sf_dir)

    @cached_property
    def chat_messages(self) -> DataFrame:
        return driver.chat_messages(self.spark, self.sf_dir)

    @cached_property
    def chat_queries(self) -> DataFrame:
        return driver.chat_queries(self.spark, self.sf_dir)

    @cached_property
    def assistant_replies(self) -> DataFrame:
        return driver.assistant_replies(self.spark, self.sf_dir)

    @cached_property
    def events(self) -> DataFrame:
        return driver.analytics_events(self.spark, self.sf_dir)

    @cached_property
    def users(self) -> DataFrame:
        return driver.users(self.spark, self.sf_dir)

    @cached_property
    def tickets(self) -> DataFrame:
        return driver.support_tickets(self.spark, self.sf_dir)

    @cached_property
    def escalations(self) -> DataFrame:
        return driver.escalations(self.spark, self.sf_dir)

    @cached_property
    def courses(self) -> DataFrame:
        return driver.courses(self.spark, self.sf_dir)

    # derived tables ---------------------------------------------------------
    @cached_property
    def violations(self) -> DataFrame:
        """guardrail_violations = G5 over the user turns."""
        from parley.operators.guardrails import violations_table
        return violations_table(self.chat_queries)

    @cached_property
    def user_queries(self) -> DataFrame:
        """User turns with ``query`` (stripped, non-empty) and ``_t`` (its
        lower-cased, stripped form, the text every rule reads)."""
        from pyspark.sql import functions as F

        from parley.functions.text import norm, strip_ws
        q = self.chat_queries.select("id", "conversation_id", "turn", "user_id", "created_at",
                                     strip_ws(F.col("content")).alias("query"))
        return q.where(F.length("query") > 0).withColumn("_t", norm(F.col("query")))

    @cached_property
    def decisions(self) -> DataFrame:
        from parley.plans.pipeline import classify_messages
        return classify_messages(self.chat_messages)
