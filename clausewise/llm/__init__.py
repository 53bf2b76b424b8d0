"""Training-data operators: quality, packing, scoring, dedup, filters.  Nothing outside this folder imports it."""
