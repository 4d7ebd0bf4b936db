"""factloom: evidence-graph analytics and training-data preparation as plain Spark jobs."""

__version__ = "0.1.0"
