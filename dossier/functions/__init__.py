"""Column builders without Python in the row path."""
