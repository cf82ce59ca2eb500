"""evwatch: event surveillance and corpus preparation as PySpark DataFrame operators."""
