"""tracelake: exposure auditing of large file and document collections on Spark."""
