"""lanwatch: network anomaly analytics written as PySpark DataFrame operators."""
