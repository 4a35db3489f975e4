"""hopframe: multi-hop question-answering corpora on Spark DataFrames.

Every operator takes DataFrames (or Columns) and returns a lazy DataFrame (or
Column); two-output operators return ``(kept, rejects)``.
"""

__version__ = "0.1.0"
