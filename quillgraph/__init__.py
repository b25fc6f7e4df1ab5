"""quillgraph: a PySpark-native engine for citation graphs and text corpora."""
