"""End-to-end pipelines over the operators."""
