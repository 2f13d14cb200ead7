"""Readers: Markdown bytes, JSON state, manifests, directory trees, paginated resources; and the writers of their results."""
