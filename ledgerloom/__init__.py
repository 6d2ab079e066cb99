"""ledgerloom: cost allocation, tagging compliance and data preparation on PySpark.

Every public function takes and returns DataFrames, takes its parameters as
arguments and leaves planning and execution to Spark.
"""
