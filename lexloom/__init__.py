"""Legal-document analytics as Spark DataFrame operators."""
