"""Column expressions shared by the operators; all are Spark built-ins."""
