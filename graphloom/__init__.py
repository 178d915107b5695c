"""graphloom: code-intelligence analytics and corpus preparation as PySpark plans.

Every operator is a function from DataFrames to a DataFrame.  Nothing here keeps a global session; the
caller passes one in.
"""

__version__ = "0.1.0"
