"""Corpus preparation for language-model training.

Ten operators over documents, conversations, pages and embeddings.  The package stands alone: it
imports nothing from the rest of the library and nothing else in the library imports it.
"""
