"""Driver-facing checks: fixture views, registered queries and their SQL."""
