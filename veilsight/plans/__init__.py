"""Commands, bindings to the sample tables, and the query registry."""
