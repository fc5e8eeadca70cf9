"""Schemas, scans, sinks and adapter views."""
