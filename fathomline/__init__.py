"""fathomline: a Spark-native analytics engine for dated public evidence.

Subpackages: ``functions`` (column expressions and scalar parsers), ``operators`` (DataFrame -> DataFrame),
``sources`` (readers and writers), ``plans`` (registered queries and their SQL), ``streaming`` (Structured Streaming
forms) and the optional ``llm`` (training-data operators; nothing here imports it).
"""

__version__ = "0.1.0"
