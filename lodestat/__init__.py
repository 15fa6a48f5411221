"""lodestat: a PySpark-native engine that checks reported numbers against tabular data.

Layout: ``sources`` reads and writes, ``functions`` holds Column expressions,
``operators`` the relational and statistical operators, ``plans`` the closed plan
language, ``streaming`` the Structured Streaming operators, ``queries`` the
registered queries with their SQL.  ``llm`` holds operators for text corpora;
nothing outside of it imports it.
"""

__version__ = "0.1.0"
