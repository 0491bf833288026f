"""Named views over the input tables and the catalogue of queries with their SQL counterparts."""
