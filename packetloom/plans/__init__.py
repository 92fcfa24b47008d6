"""Queries over the domain views of the test tables, each with the SQL that it is held against."""

from . import evaluation, flows, preparation, sessions

QUERIES = preparation.QUERIES | flows.QUERIES | evaluation.QUERIES | sessions.QUERIES
ORACLES = preparation.ORACLES | flows.ORACLES | evaluation.ORACLES | sessions.ORACLES
