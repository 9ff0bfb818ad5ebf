"""farepath: trip analytics on Spark DataFrames.

Every public operator takes DataFrames plus column names and returns a
DataFrame. The operators create no session and fix no path. Actions run
only where something is materialised on purpose: the sinks, the bounded
size checks that guard a broadcast, the checkpointed per-group maxima of
the arg-max, and (for the driver's tables only) the derived trip and
zone tables written once per session by ``sources.tables``.
"""

__version__ = "0.1.0"
