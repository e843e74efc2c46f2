"""Roll-ups and comparisons of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import COMPLETION_PRICE, PROMPT_PRICE


def summary(rows: DataFrame, digits: int = 6) -> DataFrame:
    """system, type, domain (null: all), n and the means of the scores.

    One pass with grouping sets over (system), (system, type), (system, domain).
    ``rows``: system, type, domain, f1, exact, coverage, token_f1, extractable,
    strict, total_tokens, cost.
    """
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), digits)
    grouped = rows.groupingSets([["system"], ["system", "type"], ["system", "domain"]], "system", "type", "domain")
    return grouped.agg(
        F.count("*").alias("n"),
        *[rate(c).alias(f"mean_{c}") for c in ("f1", "exact", "coverage", "token_f1", "extractable", "strict")],
        F.round(F.avg("total_tokens"), 3).alias("mean_tokens"),
        F.round(F.sum("cost"), digits).alias("total_cost"),
    )


def older_summary(rows: DataFrame) -> DataFrame:
    """system, type, hop (null: all): macro f1, mean yield of rows that have one, tokens, cost."""
    grouped = rows.groupingSets([["system"], ["system", "type"], ["system", "hop"]], "system", "type", "hop")
    return grouped.agg(
        F.count("*").alias("n"),
        F.round(F.avg("f1"), 4).alias("macro_f1"),
        F.round(F.avg(F.when(F.col("rds") > 0, F.col("rds"))), 8).alias("macro_rds"),
        F.round(F.avg("total_tokens"), 1).alias("mean_tokens"),
        F.round(F.sum("cost"), 4).alias("total_cost"),
    )


def new_spend(rows: DataFrame, digits: int = 6) -> DataFrame:
    """system (null: all), new_api_spend_usd; the router's rows are others' rows again and do not count in the total.

    ``rows``: system, new_api_spend_usd (null: nothing spent).
    """
    spent = F.coalesce("new_api_spend_usd", F.lit(0.0))
    both = rows.select("system", spent.alias("own"), F.when(F.col("system") == "router", 0.0).otherwise(spent).alias("counted"))
    amount = F.when(F.grouping("system") == 0, F.sum("own")).otherwise(F.sum("counted"))
    return both.groupingSets([["system"], []], "system").agg(F.round(amount, digits).alias("new_api_spend_usd"))


def recomputed(rows: DataFrame) -> DataFrame:
    """n, macro_f1, mean_tokens, cost of rows whose cost is told anew from their tokens.

    ``rows``: f1, prompt_tokens, completion_tokens.
    """
    prompt, completion = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    return rows.agg(
        F.count("*").alias("n"),
        F.round(F.avg("f1"), 6).alias("macro_f1"),
        F.round(F.avg(prompt + completion), 3).alias("mean_tokens"),
        F.round(F.sum(prompt) * PROMPT_PRICE + F.sum(completion) * COMPLETION_PRICE, 6).alias("cost"),
    )


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, l, r of two score tables (id, value); an id that one side lacks is an error."""
    both = left.select("id", F.col("value").alias("l"), F.lit(True).alias("_l")).join(right.select("id", F.col("value").alias("r"), F.lit(True).alias("_r")), "id", "full_outer")
    known = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    checked = F.when(known, F.col("l")).otherwise(F.raise_error(F.concat(F.lit("id on one side only: "), F.col("id").cast("string"))).cast("double"))
    return both.select("id", checked.alias("l"), "r")


def win_loss_tie(left: DataFrame, right: DataFrame) -> DataFrame:
    """wins, losses, ties of the left side, n."""
    pairs = aligned(left, right)
    return pairs.agg(F.count_if(F.col("l") > F.col("r")).alias("wins"), F.count_if(F.col("l") < F.col("r")).alias("losses"), F.count_if(F.col("l") == F.col("r")).alias("ties"), F.count("*").alias("n"))


def paired_ratios(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ratio and lift of mean scores, reduction of mean tokens and cost, win rate.

    Both tables: id, value, tokens, cost.
    """
    mean = lambda df, p: df.agg(F.avg("value").alias(f"{p}v"), F.avg("tokens").alias(f"{p}t"), F.sum("cost").alias(f"{p}c"))
    both = mean(left, "l").crossJoin(mean(right, "r")).crossJoin(win_loss_tie(left, right))  # one row each
    less = lambda a, b: F.round(1 - F.try_divide(F.col(a), F.col(b)), 6)
    return both.select(
        F.round(F.try_divide(F.col("lv"), F.col("rv")), 6).alias("f1_ratio"), F.round(F.col("lv") - F.col("rv"), 6).alias("absolute_lift"),
        less("lt", "rt").alias("token_reduction"), less("lc", "rc").alias("cost_reduction"), F.round(F.col("wins") / F.col("n"), 6).alias("win_rate"),
    )


def gap_closed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gap_closed: (graph - base) / (frontier - base), 0 where that has no meaning.

    ``rows``: keys, mode (base, graph, frontier), f1.
    """
    means = rows.groupBy(*keys).pivot("mode", ["base", "graph", "frontier"]).agg(F.avg("f1"))
    return means.select(*keys, F.round(F.coalesce(F.try_divide(F.col("graph") - F.col("base"), F.col("frontier") - F.col("base")), F.lit(0.0)), 6).alias("gap_closed"))
