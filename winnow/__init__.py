"""winnow: DataFrame operators and jobs for triaging static-analysis findings on Spark."""
