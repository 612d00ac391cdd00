"""Sources of the hiring-analytics engine."""
