"""Registered queries: every operator on the shared test tables, with DuckDB SQL."""
