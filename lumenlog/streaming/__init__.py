"""Maintained results over changing inputs, and queries that come and go."""
