"""Edge-cache log analytics and eviction ranking on Spark.

Sub-packages
------------
``functions``  column expressions (paths, clients, cache keys, ages, scores)
``sources``    scans and sinks (access logs, cache indexes, probe logs, catalogue)
``operators``  DataFrame -> DataFrame steps (cleaning, trace, counters, eviction ...)
``plans``      end-to-end jobs built from the operators
``streaming``  Structured Streaming versions of the counters and keyed state
``checks``     the registered queries and the SQL they are compared with
"""

from edgetide.session import build_session

__all__ = ["build_session"]
