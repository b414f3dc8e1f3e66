"""Training-data operators: classifiers, filters, deduplication and mixing for text corpora.

Nothing outside this subpackage imports it; :mod:`millrace.llm.queries` lists its queries.
"""
