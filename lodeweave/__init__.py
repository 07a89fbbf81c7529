"""A Spark-native engine for catalogue-and-ratings analytics and corpus preparation."""
