"""Tracewarden: code-audit analytics and corpus preparation on Spark DataFrames."""
