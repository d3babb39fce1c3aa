"""The per-document operators on a stream of documents."""
