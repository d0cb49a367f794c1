"""Query understanding: classification, routing, confidence and multi-step plans."""
