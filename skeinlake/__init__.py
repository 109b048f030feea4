"""skeinlake: a Spark-native analytics engine for captured web observations."""
