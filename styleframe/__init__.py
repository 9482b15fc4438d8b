"""styleframe: DataFrame-to-DataFrame building blocks for studying how people write.

Every public function takes and returns Spark DataFrames (or Columns) so that
Catalyst plans the whole job; see README.md for the operator map.

The package registers itself with Spark's cloudpickle *by value*: functions
that run inside tasks (``mapInPandas`` bodies, user callables defined here,
the Python data source) travel with the task, so executors do not need the
package installed.
"""

import sys as _sys

try:
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

from styleframe.session import get_session, scratch_path  # noqa: E402

__all__ = ["get_session", "scratch_path"]
