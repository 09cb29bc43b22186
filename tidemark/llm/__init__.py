"""Training-data operators: tokenising, deduplication, decontamination, archives.

Nothing outside this subpackage imports it.  ``tidemark.llm.queries`` lists the
queries and their SQL counterparts.
"""
