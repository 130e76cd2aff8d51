"""kinetia: Spark-native analytics over per-entity motion series and text corpora."""
