"""Operators of a training-data pipeline over a corpus of documents.

Each module holds one operator with its own general interface; the thin
``opN_*`` queries over the given tables are in :mod:`farepath.llm.queries`.
Nothing else in the library imports this package.

Conventions shared by all operators: a NULL text counts as the empty text;
input frames may hold further columns of any name (only the named ones are
read); repeated rows are kept as rows of their own; an empty table gives an
empty result with the full schema.
"""
