"""All queries over the standard tables, and the SQL that each must equal."""

from . import decisions, gatekeeping, history, ledgers, reads, records, requirements, scans, streams, structures, texts
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "decisions", "gatekeeping", "history", "ledgers", "reads", "records", "requirements", "scans", "streams", "structures", "texts"]
