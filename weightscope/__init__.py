"""weightscope: model artifacts as tables, on Spark."""
