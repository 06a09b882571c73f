"""stemma: text-graph analytics expressed as Spark DataFrames.

A corpus is a set of columnar tables (slots, nodes, features, edges, sections). Every operator is a
function from DataFrames to a DataFrame; Catalyst plans the execution.
"""

__version__ = "0.1.0"
