"""Query registry and SQL counterparts."""
