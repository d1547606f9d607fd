"""grafwerk: constraint checking, repair and rule mining for labelled graphs on Spark.

The subpackage ``grafwerk.llm`` (text operators for training data) stands alone:
nothing outside of it imports it.
"""

__version__ = "0.1.0"
