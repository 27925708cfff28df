"""Training-data operators: one module per operator, one query per operator.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries when the subpackage is present.
"""
