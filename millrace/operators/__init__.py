"""Operators on DataFrames: resuming, merging, records, telemetry."""
