"""Content-risk analytics on Spark: facts, evidence, risk scores and verdicts for tables of files."""

__version__ = "0.1.0"
