"""The operators bound to the driver's tables, and the same results in DuckDB SQL."""
