"""The tables and the three named views as temporary views, for questions asked in SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from looptrace.plans.customers import vw_customer_balances
from looptrace.plans.packaging import pkg_last_location, vw_checkout_enriched

# View name -> the report behind it and the tables that one takes.
VIEWS = {
    "v_instance_last_location": (pkg_last_location, ("movements",)),
    "v_checkout_enriched": (
        vw_checkout_enriched,
        (
            "checkouts", "customers", "packaging_instances", "packaging_catalog", "retailers",
            "locations",
        ),
    ),
    "v_customer_balances": (
        vw_customer_balances,
        ("customers", "deposit_accounts", "deposit_transactions"),
    ),
}


def register_views(tables: Mapping[str, DataFrame]) -> list[str]:
    """Registers the given tables, and each view whose tables are all given; returns the names."""
    named = dict(tables.items())
    for name, (report, needs) in VIEWS.items():
        if all(n in named for n in needs):
            named[name] = report(*(named[n] for n in needs))
    for name, df in named.items():
        df.createOrReplaceTempView(name)
    return list(named)
