"""quarry: key-equality joins and training-data operators, expressed Spark-first."""
