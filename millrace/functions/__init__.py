"""Column expressions: cell coercion and schema checks."""
