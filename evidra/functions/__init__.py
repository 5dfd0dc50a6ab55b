"""Column functions: text, URLs, time, hashing and JSON."""
