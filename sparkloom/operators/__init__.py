"""Schema-generic operators: column names are parameters."""
