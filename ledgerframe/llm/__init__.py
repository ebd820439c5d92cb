"""Training-data pipeline operators: one module per operator, plus ``queries`` which registers them.

Nothing else in the library imports this subpackage.
"""
