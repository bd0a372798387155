"""End-to-end jobs, test-data bindings and registered queries."""
