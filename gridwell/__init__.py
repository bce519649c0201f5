"""An analytics engine for simulation-style data on Spark.

A row of a table is an element of a mesh; its columns are fields. Expressions,
binnings, histograms, selections, history operators and declarative actions all
become DataFrame plans.
"""
