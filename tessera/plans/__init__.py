"""Query plans: the engine's operators applied to the driver's tables, with DuckDB counterparts."""
