"""The registered queries and their SQL, by area."""

from . import pages, reading, requests, scores, store, texts

QUERIES: dict = store.QUERIES | texts.QUERIES | scores.QUERIES | reading.QUERIES | requests.QUERIES | pages.QUERIES
ORACLES: dict = store.ORACLES | texts.ORACLES | scores.ORACLES | reading.ORACLES | requests.ORACLES | pages.ORACLES
