"""Plans: named inputs over the driver tables, the end-to-end analysis and the query registry."""
