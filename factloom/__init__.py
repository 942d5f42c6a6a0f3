"""factloom: a Spark-native engine for fusing product attributes from many documents."""
