"""shiftlab: distribution-shift analytics as Spark DataFrame operators.

Rebalance a table by a signed slider, encode features, split and score
classifiers, rank features and sweep the slider for the best distribution.
Every operator takes and returns DataFrames; see README.md for the map.
"""

__version__ = "0.1.0"
