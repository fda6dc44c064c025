"""The store: files, manifest, write path."""
