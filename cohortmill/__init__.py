"""Evidence tables and two-cohort screens on Spark."""
