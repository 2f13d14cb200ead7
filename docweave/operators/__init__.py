"""DataFrame operators on lines, units, pages, storage markup, plans and state."""
