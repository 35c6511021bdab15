"""A PySpark-native analytics engine for claim graphs.

Subpackages: ``sources`` (readers, sinks, adapters), ``functions`` (column
expressions), ``operators`` (DataFrame in, DataFrame out), ``plans`` (the named
queries and their SQL twins) and ``streaming`` (the incremental fold).
"""

__version__ = "0.1.0"
