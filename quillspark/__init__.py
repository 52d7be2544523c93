"""quillspark: text analytics as ordinary Spark DataFrame operations."""
