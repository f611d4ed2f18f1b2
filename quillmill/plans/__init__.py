"""plans of quillmill."""
