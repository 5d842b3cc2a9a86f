"""Readers and writers: trade-event messages, test tables, alert sinks."""
