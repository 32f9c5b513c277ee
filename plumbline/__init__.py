"""Data-readiness analytics as lazy PySpark DataFrame functions.

Sub-packages: ``functions`` (column expressions), ``sources`` (catalogs, samples,
sinks), ``operators`` (comparison, quality, request logs, gaps, scoring,
remediation, run tables), ``streaming`` (the same on event streams) and ``plans``
(whole assessments built from the operators).
"""

__version__ = "0.1.0"
