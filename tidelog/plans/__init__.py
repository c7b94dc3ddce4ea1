"""The query language: tokens, predicates, edits; and the registered queries."""
