"""Code used inside tasks travels with the job, so executors need no copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    """Send the functions of a module to the executors by value."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
