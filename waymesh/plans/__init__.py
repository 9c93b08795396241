"""End-to-end plans: networks from extracts, path pre-computation, importance, test data."""
