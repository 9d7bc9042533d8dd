"""Tables: definitions, readers and derived tables."""
