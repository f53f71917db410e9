"""Column functions. Everything here is a Catalyst expression; no Python runs per row."""
