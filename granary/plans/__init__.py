"""Query plans and their registry, the SQL surface, query handles and tuning."""
