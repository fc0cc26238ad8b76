"""Training-data operators: tokenising, scoring, sharding, packing, de-duplication, search and extraction at corpus scale."""
