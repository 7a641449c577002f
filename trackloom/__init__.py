"""Detection, tracking and redaction operators over video tables, as Spark DataFrame functions."""
