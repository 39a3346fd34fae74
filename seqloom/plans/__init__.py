"""The engine's interface, its index tables, and the registered queries with their SQL."""
