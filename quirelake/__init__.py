"""Document-structure analytics on PySpark: positional, label, graph and tree operators, codecs and a PDF source."""
