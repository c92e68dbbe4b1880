"""Accounts: billing sources, costs that are booked, ledgers, transfers and reports by week."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plans that a usage record is marked with.
MARKS = {"subscription": "sub", "byok": "byok", "lite": "lite"}


def billing_source(row: dict[str, Column]) -> Column:
    """Who pays for a call, or what refuses it, as the first that holds.

    ``row`` has booleans anonymous, byok, free, subscription, subscription_limited, subscription_use_balance, lite,
    lite_limited, lite_use_balance, payment_method, workspace_limited, user_limited, and the number balance. A plan at
    its limit refuses the call unless it lets the balance pay.
    """
    none = F.lit(None).cast("string")
    after_lite = (
        F.when(~row["payment_method"], "error:no payment method")
        .when(row["balance"] <= 0, "error:insufficient balance")
        .when(row["workspace_limited"], "error:workspace limit")
        .when(row["user_limited"], "error:user limit")
        .otherwise("balance")
    )

    def plan(name: str) -> Column:
        limited = F.when(row[f"{name}_use_balance"], none).otherwise("error:quota exceeded")
        return F.when(row[name], F.when(row[f"{name}_limited"], limited).otherwise(name))

    early = F.when(row["anonymous"], "anonymous").when(row["byok"], "byok").when(row["free"], "free")
    return F.coalesce(early, plan("subscription"), plan("lite"), after_lite)


def usage_rows(calls: DataFrame) -> DataFrame:
    """Rows to book for calls (id, workspace, source, cents): cost in micro-cents, the plan's mark; anonymous calls book none."""
    mark = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])[F.col("source")]
    return calls.where("source <> 'anonymous'").withColumn("cost", F.round(F.col("cents") * 1_000_000).cast("long")).withColumn("plan", mark)


def booked(usage: DataFrame, balances: DataFrame) -> DataFrame:
    """(workspace, balance): what is left after usage paid from the balance; free and own-key calls cost nothing."""
    paid = usage.where("source = 'balance'").groupBy("workspace").agg(F.sum("cost").alias("__c"))
    left = F.col("balance") - F.coalesce("__c", F.lit(0))
    return balances.join(paid, "workspace", "left").select("workspace", left.alias("balance"))


def to_reload(balances: DataFrame, trigger: Column, locked: Column) -> DataFrame:
    """Accounts below their trigger that are not locked by a reload under way."""
    return balances.where((F.col("balance") < trigger) & ~F.coalesce(locked, F.lit(False)))


def granted(ledger: DataFrame, grants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger (account, amount, kind) with a credit row for each grant (account, amount), and the balances by account."""
    rows = ledger.unionByName(grants.select("account", "amount", F.lit("credit").alias("kind")))
    return rows, rows.groupBy("account").agg(F.sum("amount").alias("balance"))


def refunded(payments: DataFrame, refunds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payments (payment, account, amount) with ``refunded_at`` of refunds (payment, at), and a negative ledger row for each payment refunded.

    A payment is refunded once, at the first time; a refund of an unknown payment does nothing.
    """
    first = refunds.groupBy("payment").agg(F.min("at").alias("refunded_at"))
    out = payments.join(first, "payment", "left")
    ledger = out.where("refunded_at is not null").select("account", (-F.col("amount")).alias("amount"), F.lit("refund").alias("kind"))
    return out, ledger


def transferred(frames: dict[str, DataFrame], mapping: DataFrame, column: str = "account") -> dict[str, DataFrame]:
    """Every frame with its owners (``column``) replaced by a mapping (old, new); others keep theirs."""
    m = mapping.select(F.col("old").alias(column), F.col("new").alias("__new")).dropDuplicates([column])
    return {n: f.join(m, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new") for n, f in frames.items()}


def alive(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key whose ``deleted`` is not set; a later upsert brings a deleted key back."""
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), version).alias("__r"))
    return latest.select(*keys, "__r.*").where("deleted is null")


def exists(rows: DataFrame, condition: Column) -> bool:
    """Whether any row fits; stops at the first."""
    return not rows.where(condition).limit(1).isEmpty()


def weekly_columns(rows: DataFrame, key: str, week: str, value: str, weeks: list | None = None) -> DataFrame:
    """One column of sums for each week key, missing ones 0; the weeks are those of the rows (a bounded report) unless told."""
    listed = weeks or sorted(r[0] for r in rows.select(week).distinct().where(F.col(week).isNotNull()).collect())
    wide = rows.groupBy(key).pivot(week, listed).agg(F.sum(value))
    return wide.select(key, *[F.coalesce(F.col(f"`{w}`"), F.lit(0)).alias(f"w{w}") for w in listed])


def with_deltas(report: DataFrame, order: str, values: list[str]) -> DataFrame:
    """A report of one row a day with what each value has grown by since the row before; the first grows from 0."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(order)  # a row a day
    return report.select("*", *[(F.col(v) - F.lag(v, 1, 0).over(w)).alias(f"{v}_delta") for v in values])


def task_scores(results: DataFrame) -> DataFrame:
    """(agent, task, score) of results (agent, result) whose JSON holds ``tasks: [{id, averageScore}]``; tasks without an id are left out."""
    tasks = F.from_json(F.get_json_object("result", "$.tasks"), "array<struct<id: string, averageScore: double>>")
    return results.select("agent", F.inline(tasks)).where("id is not null").select("agent", F.col("id").alias("task"), F.col("averageScore").alias("score"))


def score_table(results: DataFrame) -> DataFrame:
    """One row for each agent and one column for each task that any result names, in their order."""
    scores = task_scores(results)
    tasks = [r[0] for r in scores.select("task").distinct().orderBy("task").collect()]  # columns of a page
    return scores.groupBy("agent").pivot("task", tasks).agg(F.first("score"))


def page_bounds(page: int | None, limit: int | None, default: int = 20) -> tuple[int, int]:
    """(limit, offset) with the limit between 1 and 100 and pages from 1."""
    size = min(100, max(1, limit if limit is not None else default))
    return size, (max(1, page or 1) - 1) * size


def checked_action(action: str, allowed=("query", "ingest", "deanonymize", "delete")) -> str:
    """The action, if it is one that may be asked for."""
    if action not in allowed:
        raise ValueError(f"unknown action {action!r}; one of {', '.join(allowed)}")
    return action


def exposition(counters: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """(line): metrics in the text form that scrapers read."""
    said = F.concat(F.lit(name + "{" + label + '="'), F.regexp_replace(F.col(label), r'(["\\])', r"\\$1"), F.lit('"} '), F.col(value).cast("string"))
    return counters.select(said.alias("line"))


def histogram(rows: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(le, n): how many values are at most each bound and in all, from one pass: one sum for each bound."""
    sums = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = rows.agg(*sums, F.count(value).alias("total"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return one.select(F.inline(F.array(*pairs, F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))))


def floats(blob: Column) -> Column:
    """Little-endian 32-bit numbers of a blob as an array; null where its length is no multiple of four."""
    @F.pandas_udf("array<float>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return read(blob)


def blob(values: Column) -> Column:
    """An array of numbers as little-endian 32-bit bytes."""
    @F.pandas_udf("binary")
    def write(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return write(values)
