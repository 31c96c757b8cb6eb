"""corpusloom: a PySpark-native document analytics and retrieval evaluation engine."""
