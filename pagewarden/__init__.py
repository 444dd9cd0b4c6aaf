"""Page privacy and perception analytics as PySpark DataFrame operators."""
