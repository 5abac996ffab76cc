"""Training-data operators: text, tokens, near-duplicates and archives on Spark.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
