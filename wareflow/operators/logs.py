"""Conversation, audit, usage and evaluation logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareflow.functions.security import mask

#: Weights of an evaluation score; daily budget of tokens with its thresholds in percent.
WEIGHTS = {"correct": 0.4, "citation": 0.3, "refusal": 0.2, "latency": 0.1}
DAILY_TOKENS, ALERT_PCT, KILL_PCT = 2_000_000, 80, 100
ROUTES = {"product_search": "search", "compare": "compare", "build_pc": "build", "policy": "retrieve", "small_talk": "answer"}


def _millis(end: str, start: str) -> Column:
    """Whole milliseconds between two timestamps."""
    return F.floor((F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1000).cast("long")


def masked_last_user(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, text): the last user message of each conversation, masked before any use."""
    last = messages.where(F.col("role") == "user").groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), F.col("turn")).alias("m"))
    return last.select("conv_id", "m.turn", mask(F.col("m.text")).alias("text"))


def transcripts(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, transcript): turns in order, one line each; tool calls and results in brackets."""
    line = F.when(F.col("role") == "tool", F.concat(F.lit("[tool result: "), F.col("text"), F.lit("]"))).otherwise(F.concat(F.col("role"), F.lit(": "), F.col("text")))
    ordered = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return messages.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(ordered, lambda t: t["line"]), "\n").alias("transcript"))


def route(intent: Column) -> Column:
    return F.coalesce(*[F.when(intent == k, v) for k, v in ROUTES.items()], F.lit("answer"))


def clean_tool_calls(calls: DataFrame) -> DataFrame:
    """``calls`` (id, name, args) with the reason why a call is dropped; null for a good one."""
    reason = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "missing_name").when(F.coalesce(F.trim("id"), F.lit("")) == "", "missing_id").when(F.try_parse_json("args").isNull(), "invalid_args")
    return calls.withColumn("drop_reason", reason)


def audit_rows(actions: DataFrame) -> DataFrame:
    """Masked targets and the size of responses in bytes."""
    return actions.withColumn("target", mask(F.col("target"))).withColumn("response_bytes", F.octet_length(F.coalesce("response", F.lit("")))).drop("response")


def step_durations(events: DataFrame) -> DataFrame:
    """(step_id, step_type, status, duration_ms) of start and end rows (step_id, step_type, event, status, ts)."""
    start = events.where(F.col("event") == "start").groupBy("step_id", "step_type").agg(F.min("ts").alias("t0"))
    end = events.where(F.col("event") == "end").groupBy("step_id").agg(F.min(F.struct("ts", "status")).alias("e"))
    ms = _millis("e.ts", "t0")
    return start.join(end, "step_id").select("step_id", "step_type", "e.status", ms.alias("duration_ms"))


def span_tree(spans: DataFrame) -> DataFrame:
    """Spans (span_id, parent_id, name, t0, t1) with their parent's name and duration in ms."""
    up = spans.select(F.col("span_id").alias("parent_id"), F.col("name").alias("parent_name"))
    return spans.join(up, "parent_id", "left").select("span_id", "parent_id", "parent_name", "name", _millis("t1", "t0").alias("duration_ms"))


def daily_usage(events: DataFrame) -> DataFrame:
    """(day, tokens, requests, percent, alert, killed); events without tokens are not recorded."""
    day = events.where("tokens > 0").groupBy(F.to_date("ts").alias("day")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("requests"))
    return budget_flags(day)


def budget_flags(day: DataFrame, budget: int = DAILY_TOKENS) -> DataFrame:
    percent = F.floor(F.col("tokens") * 100 / budget).cast("long")
    return day.withColumn("percent", percent).withColumn("alert", F.col("percent") >= ALERT_PCT).withColumn("killed", F.col("percent") >= KILL_PCT)


def eval_scores(results: DataFrame, group: str) -> DataFrame:
    """Composite score by group of rows with the four parts (0 to 1)."""
    total = sum((F.col(k).cast("double") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return results.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(total), 6).alias("score"))


def dedupe_citations(citations: DataFrame) -> DataFrame:
    """First citation of each (answer, product, slug, claim) by position."""
    return citations.groupBy("answer_id", "product_id", "slug", "claim").agg(F.min("position").alias("position"))


def recommendation_context(hits: DataFrame, specs: DataFrame, base_url: str) -> DataFrame:
    """Per query the top three products as text: name, price, stock, up to four specification bullets, URL."""
    from wareflow.functions.text import money, stock_text

    bullets = F.transform(F.slice("specs", 1, 4), lambda s: F.concat(s["key"], F.lit(": "), s["value"]))
    top = hits.where("rank <= 3").join(specs, hits.id == specs.product_id, "left")
    text = F.concat_ws("\n", "name", money(F.col("price_vnd")), stock_text(F.col("stock_status")), F.concat_ws("; ", bullets), F.concat(F.lit(base_url), F.col("slug"), F.lit(".html")))
    ordered = F.sort_array(F.collect_list(F.struct("rank", text.alias("text"))))
    return top.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("context"))
