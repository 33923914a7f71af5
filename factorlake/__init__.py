"""Point-in-time panel research on Spark: factors, rankings, evaluation, screens and analytics."""
