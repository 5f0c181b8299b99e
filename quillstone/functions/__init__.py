"""Part of the quillstone engine."""
