"""glossa: prepare document collections for machine translation with Spark.

Every public operator takes DataFrames and returns a DataFrame.  Rows stay on the
executors; what a driver sees is bounded by parameters (rounds, plans, models, counts
per partition).  The service that is called for a text is a function of the user.
"""

__version__ = "0.1.0"
