"""quillgraph: repository-intelligence analytics as Spark jobs.

Every operator is a function from DataFrames to a DataFrame; nothing is
executed until the caller runs an action, except where an iterative operator
has to test whether its frontier is empty.
"""

__version__ = "0.1.0"
