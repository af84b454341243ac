"""Training-data operators: token files, archives, extraction, rules, deduplication, packing, formatting.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()``
collect the registered query of every operator; ``__spark_entry__`` adds them when the
subpackage is present.
"""
