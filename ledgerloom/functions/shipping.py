"""Send the few Python helpers to the workers with the task, so executors need no copy of the package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship_with_tasks(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
