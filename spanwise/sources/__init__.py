"""Readers and writers for telemetry files."""
