"""Job-posting intelligence and training-data preparation on PySpark."""
