"""sparkloom: a PySpark-native engine for keyed stores, graphs, alignment and sorting.

Everything is expressed over DataFrames; see README.md for the operator list.
"""

__version__ = "0.1.0"
