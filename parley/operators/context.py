"""Conversation-context features.

Every feature looks at a bounded number of *prior* messages of the same
conversation (the current message is not part of its own context).

Plan (``strategy="block"``, the default): a conversation is cut into blocks of
``BLOCK`` turns and the last rows of each block are copied into the next, so
the frame is a bounded window inside ``(conversation_id, block)``.  That is one
exchange which carries each text 1 + k/BLOCK times, a conversation that holds a
third of all rows is spread over all tasks, and no window is larger than a
block.

Blocks rely on dense turns (0, 1, 2, ...).  A gap or a repeated turn is an
error at run time, never a short frame; :func:`dense_turns` numbers such input
first.  ``strategy="order"`` takes any turns, gaps and repeats: rows are range
partitioned by (conversation, turn, id) and numbered across the partitions, and
the blocks are cut by that number - one more exchange.  ``strategy="window"``
(``ROWS BETWEEN k PRECEDING`` over the whole conversation, one task per
conversation) takes any turns too and is what the tests compare with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parley.functions.rules import DEFAULT_RULES, HANDOFF_FRAME, MODEL_CONTEXT_FRAME, RuleSet
from parley.functions.text import contains_any, left
from parley.operators.ranking import number_rows

KEY = ["conversation_id", "turn"]
BLOCK = 256


def frustrated_flag(rules: RuleSet = DEFAULT_RULES) -> Column:
    """A16 per message: a *user* message containing a frustration word."""
    return ((F.col("role") == "user") & contains_any(F.lower(F.col("content")), rules.frustration_words)).cast("int")


def over_prior(messages: DataFrame, k: int, features: dict[str, Column], ahead: dict[str, Column] | None = None,
               strategy: str = "block") -> DataFrame:
    """``messages`` with ``features`` (aggregates over the ``k`` prior messages)
    and ``ahead`` (columns of the next message).

    ``features`` values are unapplied aggregate columns; ``ahead`` values are
    columns of the next row.  Equal turns are in ``id`` order where there is an
    ``id``.  With ``strategy="order"`` the result has ``position``, the number
    of messages before a row.
    """
    ahead = ahead or {}
    by = ["turn", "id"] if "id" in messages.columns else ["turn"]
    if strategy == "window":
        w = W.partitionBy("conversation_id").orderBy(*by)
        return messages.select("*", *[f.over(w.rowsBetween(-k, -1)).alias(n) for n, f in features.items()],
                               *[F.lead(c).over(w).alias(n) for n, c in ahead.items()])
    if not 0 < k < BLOCK:
        raise ValueError(f"frames of 1 to {BLOCK - 1} messages")
    if strategy == "order":
        messages = number_rows(messages, ["conversation_id"], [F.col(c) for c in by], "position")
        by = ["position"]
    else:
        by = ["turn"]
    cols, turn = messages.columns, F.col(by[0])
    block, place = F.floor(turn / BLOCK), F.pmod(turn, F.lit(BLOCK))
    copy = lambda shift: F.struct((block + shift).alias("block"), F.lit(shift).alias("shift"))
    into = F.array_compact(F.array(copy(0), F.when(place >= BLOCK - k, copy(1)),
                                   F.when((place == 0) & (block > 0), copy(-1)) if ahead else F.lit(None)))
    rows = messages.select("*", F.explode(into).alias("_at")).select(*cols, "_at.block", "_at.shift")
    w = W.partitionBy("conversation_id", "block").orderBy(*by)
    before = F.lag(turn).over(w)
    dense = F.when(turn == 0, before.isNull()).otherwise(F.coalesce(before == turn - 1, F.lit(False)))
    rows = rows.select("*", dense.alias("_dense"), *[f.over(w.rowsBetween(-k, -1)).alias(n) for n, f in features.items()],
                       *[F.lead(c).over(w).alias(n) for n, c in ahead.items()])
    gap = F.raise_error(F.concat(F.lit("turns are not dense (use dense_turns): conversation "),
                                 F.col("conversation_id").cast("string"), F.lit(" turn "), turn.cast("string")))
    added = [F.when(F.col("_dense"), F.col(n)).otherwise(gap).alias(n) for n in (*features, *ahead)]
    return rows.where("shift = 0").select(*cols, *added)


def frustration_features(rules: RuleSet = DEFAULT_RULES) -> dict[str, Column]:
    """W1 inputs over a frame, of rows that carry the flag ``_f``."""
    return {"n_prior": F.count("_f"), "n_frustrated": F.sum("_f")}


def _row_key(messages: DataFrame, strategy: str) -> list[str]:
    """What names a row where turns can repeat."""
    return [*KEY, "id"] if strategy == "order" and "id" in messages.columns else KEY


def frustration(messages: DataFrame, rules: RuleSet = DEFAULT_RULES, strategy: str = "block") -> DataFrame:
    """W1 inputs per (conversation_id, turn): ``n_prior`` messages in the
    frame and ``n_frustrated`` frustrated user messages among them."""
    key = _row_key(messages, strategy)
    f = over_prior(messages.select(*key, frustrated_flag(rules).alias("_f")), rules.frustration_frame,
                   frustration_features(rules), strategy=strategy)
    return f.select(*key, "n_prior", F.coalesce("n_frustrated", F.lit(0)).cast("long").alias("n_frustrated"))


def is_repeated_frustration(n_prior: Column, n_frustrated: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """A full frame of prior messages and enough frustrated user turns."""
    return (F.coalesce(n_prior, F.lit(0)) >= rules.frustration_frame) & \
        (F.coalesce(n_frustrated, F.lit(0)) >= rules.frustration_min)


def recent_context(messages: DataFrame, k: int, content: Column, role: Column | None = None,
                   strategy: str = "block") -> DataFrame:
    """``messages`` with ``context``: the last ``k`` prior messages, oldest
    first, as ``array<struct<role, content>>`` (empty for a first message)."""
    item = F.struct((role if role is not None else F.col("role")).alias("role"), content.alias("content"))
    return over_prior(messages.withColumn("_item", item), k, {"context": F.collect_list("_item")},
                      strategy=strategy).drop("_item")


def model_context(messages: DataFrame, strategy: str = "block") -> DataFrame:
    """Last 6 prior messages for a model call; roles user / model."""
    role = F.when(F.col("role") == "user", "user").otherwise("model")
    key = _row_key(messages, strategy)
    m = messages.select(*key, "role", "content")
    return recent_context(m, MODEL_CONTEXT_FRAME, F.col("content"), role, strategy).select(*key, "context")


def handoff_summary(messages: DataFrame, query: Column, reason: Column | None = None,
                    strategy: str = "block") -> DataFrame:
    """Per user message the hand-off record: reason, the
    query, how many messages preceded it and the last 5 (content cut to
    200 characters), oldest first."""
    ctx = recent_context(messages, HANDOFF_FRAME, left(F.col("content"), 200), None, strategy)
    ctx = ctx.where(F.col("role") == "user").withColumn("student_query", query).where(F.length("student_query") > 0)
    return ctx.select(
        *_row_key(messages, strategy),
        (reason if reason is not None else F.lit(None).cast("string")).alias("escalation_reason"),
        "student_query",
        # Dense turns, checked above, count the messages before this one
        F.col("position" if strategy == "order" else "turn").cast("long").alias("conversation_length"),
        F.col("context").alias("recent_messages"),
    )


def message_turns(messages: DataFrame, strategy: str = "range", partitions: int | None = None) -> DataFrame:
    """Dense turn number (0-based) from time order, id as tiebreak.

    ``strategy="range"`` (default): :func:`parley.operators.ranking.number_rows`,
    which splits a hot conversation over tasks.  ``strategy="window"``:
    ``row_number()`` over the conversation - one task per conversation.
    """
    if strategy == "window":
        w = W.partitionBy("conversation_id").orderBy("created_at", "id")
        return messages.withColumn("turn", (F.row_number().over(w) - 1).cast("long"))
    return number_rows(messages, ["conversation_id"], [F.col("created_at"), F.col("id")], "turn", partitions)


def dense_turns(messages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Messages with gaps or odd starts in ``turn``, renumbered 0, 1, 2, ...
    in turn order (equal turns: by id)."""
    m = messages.withColumnRenamed("turn", "_old")
    out = number_rows(m, ["conversation_id"], [F.col("_old"), F.col("id")], "turn", partitions)
    return out.select(*messages.columns)
