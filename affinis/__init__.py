"""affinis — recommendation analytics as Spark DataFrame jobs.

Sub-packages:
    sources    readers and writers (driver tables, rating files, stores)
    functions  column-expression helpers (JVM-side built-ins only)
    operators  DataFrame -> DataFrame operators (prep, features, profile,
               ranking, metrics, quality, drift, A/B, selection)
    models     recommenders whose fitted state is a set of DataFrames
    plans      composed jobs (preprocess, train/evaluate, update loop)
    streaming  Structured Streaming versions of the ingest operators
"""

__version__ = "0.1.0"
