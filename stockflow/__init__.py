"""stockflow: inventory and warehouse analytics on Spark.

Batch operators take and return DataFrames; change operators are pure
functions ``(state, changes) -> new state`` so results can be written as
new snapshot versions. Streaming variants live in ``stockflow.streaming``.
"""

__version__ = "0.1.0"
