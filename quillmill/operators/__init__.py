"""operators of quillmill."""
