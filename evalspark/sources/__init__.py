"""Reading and writing of tables and stored objects."""
