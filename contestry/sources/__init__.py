"""Readers, reconciliation and sinks."""
