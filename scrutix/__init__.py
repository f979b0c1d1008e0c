"""Content-quality, risk and corpus analytics expressed as Spark DataFrame operators."""
