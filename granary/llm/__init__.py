"""Training-data operators: scoring, scanning, de-duplication, sharding and packing of text corpora.

Nothing outside this subpackage imports it; ``granary.llm.registry`` lists its queries and SQL.
"""
