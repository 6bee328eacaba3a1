"""A Spark-native multimodal analytics engine."""
