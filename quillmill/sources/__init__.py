"""sources of quillmill."""
