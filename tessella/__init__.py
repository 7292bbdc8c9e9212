"""Web pages and documents as tables: extraction, readiness, link graphs and roll-ups on Spark."""
