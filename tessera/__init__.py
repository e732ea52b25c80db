"""tessera — labelled-text preparation, analysis and evaluation as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (or ``Column -> Column``
for scalar text functions), so whole pipelines stay one lazy logical plan that Catalyst
optimises end to end.
"""

from tessera.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]

import sys

from pyspark import cloudpickle

# functions go to executors by value, so these need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
