"""Training-data operators: filtering, deduplication, packing and archives.

Nothing outside this subpackage imports it. ``cyclarium.llm.registry`` lists
its queries and their SQL.
"""
