"""Continuous intake of uploads."""
