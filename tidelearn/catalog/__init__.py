"""All registered queries; importing the modules fills the registry."""

from tidelearn.catalog import forms, linear, mixtures, rows, streams, topics, words  # noqa: F401
from tidelearn.catalog.registry import QUERIES, SQL  # noqa: F401
