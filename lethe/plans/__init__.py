"""Session helpers, scratch tables, reports and the query registry."""
