"""functions of quillmill."""
