"""Reading and writing tables, files, JDBC and other connectors."""
