"""lexloom: a Spark-native text-corpus analytics engine."""
