"""Market time-series analytics, strategy simulation and text pipelines on Spark."""
