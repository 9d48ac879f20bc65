"""Relational, graph and retrieval operators, one function per operator."""
