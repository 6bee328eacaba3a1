"""Tables, layouts, and readers of files."""
