"""Page layout from positioned text runs.

All steps are windows, aggregations and array functions keyed by
``(doc_id, page_no)``.  The items are shuffled once by that key; every later
step partitions by a superset of it, so only sorts inside the partitions follow.
A page is the largest group any step holds.
"""
