"""Column functions and whole-frame statistics."""
