"""Multi-hypothesis data association on Spark."""
