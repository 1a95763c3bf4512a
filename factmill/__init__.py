"""factmill: source-fact analytics as Spark DataFrames.

Sub-packages: ``sources`` (scans, manifests, fact store), ``functions`` (column
expressions and the lexer kernel), ``operators`` (relational and data-pipeline
operators), ``plans`` (whole queries), ``streaming`` (incremental file intake)
and, optionally, ``llm`` (operators on texts; nothing else imports it).
"""

__version__ = "0.1.0"
