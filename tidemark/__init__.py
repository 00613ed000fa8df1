"""tidemark: Spark-native analytics for market data, company data and text corpora."""
