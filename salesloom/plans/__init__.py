"""Tool registry and the catalogue of registered queries."""
