"""docloom: document-corpus processing as lazy PySpark DataFrame operators."""
