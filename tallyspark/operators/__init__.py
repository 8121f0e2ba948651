"""Relational building blocks: balance chains, clustering, joins, roles, decoding and evaluation."""
