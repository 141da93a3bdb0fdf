"""linefold: condense tables and streams of command output with Spark."""
