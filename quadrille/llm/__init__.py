"""Training-data operators over a ``documents`` table (doc_id, text, lang, source, ...).

Every operator is a function ``operator(docs, ...) -> DataFrame``; the thin
contract queries over the driver's tables live in :mod:`quadrille.llm.queries`.
Nothing outside this subpackage imports it.
"""
