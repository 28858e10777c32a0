"""timelode: Spark jobs that turn timed media signals into searchable, auditable tables."""
