"""Operators over streams and their state."""
