"""reqloom: Spark-native analytics over requirement documents."""
