"""tidewell: batch analytics on PySpark, written as DataFrame and SQL code."""
