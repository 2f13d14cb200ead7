"""Registered queries with their SQL oracles, grouped by what they work on."""
