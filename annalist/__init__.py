"""Conversation records as a searchable, auditable body of facts, on Spark."""
