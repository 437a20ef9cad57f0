"""PySpark library for analysing electric-vehicle charging sessions.

Every operator takes and returns DataFrames; see the subpackages:
``sources`` (readers, writers, model store), ``functions`` (column
expressions), ``operators`` (relational, modelling and scheduling
operators), ``plans`` (end-to-end pipelines), ``streaming`` (incremental
jobs) and ``registry`` (the queries checked against SQL).
"""
