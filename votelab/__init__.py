"""votelab: multi-label ensemble and evaluation engine on PySpark.

Long label tables in, ensembles for every member combination and the full metric suite out, all as
DataFrame operators. See README.md for the layout.
"""

__version__ = "0.1.0"
