"""knotwork: typed-graph analytics and data preparation on Spark DataFrames.

Sub-packages: ``sources`` (readers and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame to DataFrame), ``plans`` (the query
catalog with its SQL oracles) and ``streaming`` (incremental ingest).  The
sub-package ``llm`` holds training-data operators; nothing else imports it.
"""

__version__ = "0.1.0"
