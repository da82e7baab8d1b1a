"""Health, replication and upgrade analytics for replicated data-store fleets, on Spark."""
