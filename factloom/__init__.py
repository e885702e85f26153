"""Set-valued fact aggregation and scoring on Spark."""
