"""millrace: data jobs on tables and streams, written as Spark DataFrame plans."""
