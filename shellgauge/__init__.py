"""Risk analytics over command logs, written as Spark DataFrame programs."""
