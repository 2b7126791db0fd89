"""strandline: timeline analytics as PySpark DataFrame operators.

Every table carries a ``source_id`` and every operator works on many sources at
once; times are DOUBLE seconds from the start of the source.
"""

__version__ = "0.1.0"
