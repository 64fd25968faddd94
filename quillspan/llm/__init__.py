"""Operators for building training data: each module is one operator, and
:mod:`quillspan.llm.queries` holds the registered queries and their SQL.
Nothing outside this subpackage imports it."""
