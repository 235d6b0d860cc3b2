"""Reports on customers and their deposits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looptrace.functions.timefn import AsOf, since
from looptrace.operators.slices import running_sum


def cus_recent(
    customers: DataFrame, as_of: AsOf, days: int = 30, ordered: bool = True
) -> DataFrame:
    out = customers.filter(since(customers, "created_at", as_of, days=days)).select(
        "customer_id", "name", "email", "created_at"
    )
    return out.orderBy(F.desc("created_at"), "customer_id") if ordered else out


def cus_without_checkouts(customers: DataFrame, checkouts: DataFrame) -> DataFrame:
    # one row per buyer first: the join then never meets a customer's whole history
    buyers = checkouts.select("customer_id").distinct()
    return customers.join(buyers, "customer_id", "left_anti").select("customer_id", "name", "email")


def cus_deposit_balances(
    customers: DataFrame, deposit_accounts: DataFrame, ordered: bool = True
) -> DataFrame:
    out = customers.join(deposit_accounts, "customer_id", "left").select(
        "customer_id", "name", "balance_cents"
    )
    return out.orderBy(F.desc("balance_cents"), "customer_id") if ordered else out


def cus_running_balance(
    deposit_accounts: DataFrame,
    customers: DataFrame,
    deposit_transactions: DataFrame,
    ordered: bool = True,
    slices: int | None = None,
) -> DataFrame:
    """Balance after every ledger row; rows of one account at one time go by ``tx_id``."""
    ledger = deposit_transactions.select("account_id", "created_at", "tx_id", "delta_cents")
    ledger = running_sum(
        ledger, "account_id", ["created_at", "tx_id"], "delta_cents", "running_balance_cents",
        slices,
    )
    owners = deposit_accounts.join(customers.select("customer_id", "name"), "customer_id")
    out = ledger.join(owners, "account_id").select(
        "customer_id", "name", "created_at", "delta_cents", "running_balance_cents", "tx_id"
    )
    if ordered:
        out = out.orderBy("customer_id", "created_at", "tx_id")
    return out.drop("tx_id")


def cus_top_debits(
    customers: DataFrame, deposit_accounts: DataFrame, deposit_transactions: DataFrame, k: int = 10
) -> DataFrame:
    """Customers with the largest sum of debits, whatever their reason."""
    debit = F.when(F.col("delta_cents") < 0, -F.col("delta_cents")).otherwise(0)
    per_account = deposit_transactions.groupBy("account_id").agg(F.sum(debit).alias("debits"))
    return (
        per_account.join(deposit_accounts, "account_id")
        .groupBy("customer_id")
        .agg(F.sum("debits").alias("total_penalties"))
        .join(customers, "customer_id")
        .select("customer_id", "name", "total_penalties")
        .orderBy(F.desc("total_penalties"), "customer_id")
        .limit(k)
    )


def vw_customer_balances(
    customers: DataFrame, deposit_accounts: DataFrame, deposit_transactions: DataFrame
) -> DataFrame:
    """Stored balance beside the sum of the ledger, 0 without ledger rows."""
    per_account = deposit_transactions.groupBy("account_id").agg(
        F.sum("delta_cents").alias("ledger")
    )
    accounts = deposit_accounts.join(per_account, "account_id", "left")
    return (
        customers.join(accounts, "customer_id", "left")
        .groupBy("customer_id", "name", "balance_cents")
        .agg(F.coalesce(F.sum("ledger"), F.lit(0)).alias("ledger_sum_cents"))
    )
