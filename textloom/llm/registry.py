"""Queries of this package and, where SQL can express them, their DuckDB SQL."""

from textloom.llm import chat, classifier, counting, epsilon_grid, mixing, packing, quality, simhash, substring, warc

MODULES = [chat, classifier, counting, epsilon_grid, mixing, packing, quality, simhash, substring, warc]

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
