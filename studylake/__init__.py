"""Study-evidence quality and practice analytics as PySpark DataFrame operators."""
