"""Data reconciliation and SQL troubleshooting on Spark."""
