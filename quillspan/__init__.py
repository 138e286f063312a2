"""quillspan: a PySpark-native analytics engine for versioned public registers.

Everything is a lazy DataFrame until a sink is called.  Operators take and return
DataFrames; nothing here collects a quantity that grows with the data.
"""

__version__ = "0.1.0"
