"""quillmill: Spark-first analytics for conversational-knowledge workloads."""
