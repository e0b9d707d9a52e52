"""linewise: lineage over execution traces, built on Spark DataFrames.

Layout
------
sources/    fixed schemas, readers/writers, adapters over the driver tables
functions/  reference-path scalar functions (pure Column expressions)
operators/  event model, call scope, lineage graph, reaching writers, slicing
plans/      skew-safe ordered scans shared by the operators; the query catalog
streaming/  live lineage over a streaming trace
"""

from linewise.session import get_spark, checkpoint_dir  # noqa: F401
