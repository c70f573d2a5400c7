"""Training-data operators: one module per operator, and their registered queries in `registry`.

Nothing outside this subpackage imports it.
"""
