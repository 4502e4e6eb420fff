"""Reading and writing tables, events and files."""
