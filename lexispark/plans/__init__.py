"""Query catalogue, session set-up and staging of intermediate tables."""
