"""Stowage: a Spark-native content organizer.

Every operator is a DataFrame-to-DataFrame function; nothing runs until the caller acts.
"""

__version__ = "0.1.0"
