"""brindle: a Spark-native index of C and C++ declarations, searched with fuzzy token queries."""
