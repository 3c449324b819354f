"""Operators of a training-data pipeline over documents and web pages.

Nothing else in the library imports this subpackage; the driver contract adds its queries
only if it can be imported.  Functions that run in Python workers are shipped by value, so
executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle


def ship(module: str) -> None:
    """Ship the functions of a module of this subpackage to the workers by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)
