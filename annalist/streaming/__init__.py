"""Consolidation of the event log in bounded, replayable batches."""
