"""Pipeline observability as DataFrame-to-DataFrame operators on Spark."""
