"""Functions of the hiring-analytics engine."""
