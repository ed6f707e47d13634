"""Corpus analytics on Spark: every operator is a function from DataFrames to a DataFrame."""

__version__ = "0.1.0"


def _by_value() -> None:
    """Python functions travel to executors by value: only the driver needs this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_by_value()
