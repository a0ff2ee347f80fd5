"""Reading, writing and checking of tables."""
