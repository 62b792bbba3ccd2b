"""Adapters from files of many formats to events."""
