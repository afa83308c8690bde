"""faciesforge: well-log correlation and corpus preparation on Spark."""
