"""A Spark-native engine for transcript search, media catalogues and corpus preparation."""
