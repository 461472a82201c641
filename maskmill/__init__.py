"""maskmill: secret scanning and redaction over tables and streams, on Spark."""
