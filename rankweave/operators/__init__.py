"""Relational operators: extraction, chunking, vocabulary, graph, retrieval, evaluation."""
