"""Package of the document-intelligence engine."""
