"""All registered queries and their SQL: importing the modules fills the tables."""

from marlstone.plans import corpus, flows, retrieval, tabular  # noqa: F401
from marlstone.plans.query import ORACLE, QUERIES  # noqa: F401
