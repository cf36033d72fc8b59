"""Training-data operators: one module per operator, queries in ``queries``.

Nothing outside this folder imports it; ``__spark_entry__`` adds the queries
when the folder is present.
"""
