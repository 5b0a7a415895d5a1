"""Column functions: text, time and score helpers."""
