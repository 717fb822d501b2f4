"""Registered queries: one thin plan for each operator, with its DuckDB SQL."""
