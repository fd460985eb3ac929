"""Readers, dataset registry and result sinks."""
