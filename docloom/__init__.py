"""Document analytics on Spark: sniff, route, convert, parse, clean, compress and account for text corpora."""
