"""Spark-first analytics over half-hourly series, with counterfactual capacity queries."""
