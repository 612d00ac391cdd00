"""Operators of the hiring-analytics engine."""
