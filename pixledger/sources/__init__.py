"""Reading files into tables, and writing tables out."""
