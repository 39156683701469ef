"""How functions and constant tables reach the executors."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def by_value(module_name: str) -> None:
    """Pickle the functions of a module by value, so that executors need not have this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def read_local(path: str) -> bytes:
    """A vocabulary file of the driver's machine; its content is broadcast, executors never open the path."""
    with open(path, "rb") as f:
        return f.read()


class Shared:
    """A broadcast constant with what one worker process derives from it.

    The derived object (a compiled automaton, an unpacked table) is kept beside the broadcast value, so
    that it is built once per worker process and not once per task.
    """

    def __init__(self, spark: SparkSession, value):
        self._cell = spark.sparkContext.broadcast({"value": value})

    def derived(self, build):
        cell = self._cell.value
        if "derived" not in cell:
            cell["derived"] = build(cell["value"])
        return cell["derived"]


by_value(__name__)
