"""PySpark-native analytics for evaluation results, traces, score streams and labelled corpora."""
