"""A Spark-native library for genomic tensors: contact matrices, signals, factors, compartments, boundaries, expression."""
