"""docaudit: Spark-native analytics for collections of semi-structured documents."""
