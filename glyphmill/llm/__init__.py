"""Training-data operators: media columns, near-duplicate joins, classifiers, scans, sketches, tokenizers and mixing.

Nothing outside this package imports it. Each operator has a module of its own with a general
interface; :mod:`glyphmill.llm.queries` registers the ``opN_<name>`` queries and their SQL.
"""
