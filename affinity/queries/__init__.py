"""Queries over the given tables, with the SQL that checks them."""

from affinity.queries import als, export, features, ranking, recall

MODULES = (recall, als, features, ranking, export)
