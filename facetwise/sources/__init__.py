"""Reading tables in, and writing tables and results out."""
