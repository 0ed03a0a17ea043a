"""Column expressions and name rules. Nothing here starts a job."""
