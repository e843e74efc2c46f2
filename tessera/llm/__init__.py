"""Operators for preparing training data at scale.

Every module holds one operator with a general interface plus the thin
``opN_*`` query that applies it to its whole table.  ``registry`` lists the
queries; nothing outside this subpackage imports it.
"""
