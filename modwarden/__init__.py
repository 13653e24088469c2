"""Content-moderation analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from modwarden.profiles import DEFAULT_PROFILES, Profiles

# Python helpers travel inside the plan, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DEFAULT_PROFILES", "Profiles"]
