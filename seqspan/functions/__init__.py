"""Column functions: time codes, names, texts."""
