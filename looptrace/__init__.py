"""looptrace: analytics on deposit-based, reusable-packaging loops, on Spark."""
