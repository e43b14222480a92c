"""Column expressions. Nothing here runs a job or needs Python on executors."""
