"""veriframe: evidence reconciliation as Spark DataFrame operators.

Every operator is a function from DataFrames and parameters to a DataFrame.
"""

__version__ = "0.1.0"
