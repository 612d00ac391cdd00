"""Plans of the hiring-analytics engine."""
