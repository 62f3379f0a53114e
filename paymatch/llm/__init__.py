"""Training-data operators over documents, pages and benchmark items; nothing else in the library imports this package."""
