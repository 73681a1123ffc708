"""Training-data operators: quality, extraction, language, filters, de-duplication, counting, sharding, encoding."""
