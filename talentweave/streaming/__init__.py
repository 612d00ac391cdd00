"""Streaming of the hiring-analytics engine."""
