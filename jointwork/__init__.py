"""Collaboration analytics as plain PySpark DataFrame operators.

Every public function takes DataFrames and returns a DataFrame.  Nothing in
the package creates a session, collects a result or forces a join strategy:
the plans are declarative and Catalyst / AQE choose how to run them.
"""

__version__ = "0.1.0"
