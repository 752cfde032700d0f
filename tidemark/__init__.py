"""Session-signal and cohort-history analytics as Spark DataFrame operators."""
