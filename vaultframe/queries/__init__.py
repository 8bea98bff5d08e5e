"""Query catalogue: each module holds QUERIES (name -> callable of session and data directory) and ORACLES (name -> DuckDB SQL)."""

CATALOG = ["vaultframe.queries.problems", "vaultframe.queries.reads", "vaultframe.queries.finds", "vaultframe.queries.parses", "vaultframe.queries.states", "vaultframe.queries.surface", "vaultframe.queries.stores"]
