"""Registered queries: each composes operators over the given tables and stands beside its DuckDB SQL."""
