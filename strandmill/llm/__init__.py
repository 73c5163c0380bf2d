"""Training-data operators: ten large-corpus components built on Spark.

Nothing else in the library imports this subpackage; it may be removed as a
whole without touching the sequence engine.
"""
