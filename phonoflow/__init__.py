"""Speech and language-model analytics on PySpark."""
