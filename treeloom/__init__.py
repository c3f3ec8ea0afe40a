"""Code intelligence on DataFrames: parse, query, extract and chunk source text with Spark."""
