"""Training-data operators over the tables documents, embeddings and pages.

Nothing else in the library imports this subpackage.
"""
