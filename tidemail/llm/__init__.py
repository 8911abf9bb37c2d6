"""Training-data operators: filtering, deduplication, scoring, tokenising.

Nothing else in the library imports this subpackage.  Each operator module has
a general function over DataFrames; ``queries.py`` binds them to the test
tables under the ``opN_<name>`` names.

Rules all operators share:

* A word's or a document's content is read whole; null text counts as the
  operator states (usually: no words).
* Operators select the columns they need, so extra columns with clashing names
  never reach them; functions that return the input's columns name their own
  working columns with ``common.fresh``.
* Lineage is cut by written tables in the shared folder
  (``spark.checkpoint.dir``), so a lost executor repeats its own tasks only.
"""
