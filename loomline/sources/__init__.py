"""Readers and writers: candle files, headline files, JSON lines, reports, and the roles of the given tables."""
