"""Fact-graph analytics and corpus preparation as PySpark plans."""
