"""Corpusloom: building, querying and analysing retrieval corpora with Spark.

Every scalar is ``f(*cols, **opts) -> Column``; every operator takes and
returns DataFrames and leaves the physical plan to Catalyst.
"""

__version__ = "0.1.0"
