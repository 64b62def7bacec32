"""assay: a Spark-native engine for asking tables questions in SQL and judging the answers."""
