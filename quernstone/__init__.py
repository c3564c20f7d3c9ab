"""quernstone: prompt-injection analytics and training-data preparation on Spark.

The core (``operators``, ``sources``, ``functions``, ``plans``, ``streaming``)
never imports ``quernstone.llm``; the reverse direction is allowed.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python workers get this package's functions by value, so executors need no
    installed copy of it."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
