"""Text retrieval, evaluation and conversational telemetry on Spark DataFrames."""
