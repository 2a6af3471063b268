"""Governed data quality on Spark: checks, SQL policy, audit trail, inventories."""
