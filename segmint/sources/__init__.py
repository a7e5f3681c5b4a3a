"""Table and topic sources, keyed tables (SRC-*, SNK-1..3)."""
