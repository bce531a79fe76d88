"""Reading and writing tables and state."""
