"""Whole runs, composed of sources, operators and sinks."""
