"""Training-data operators. Nothing else in the package imports this subpackage."""

from . import conversations, fingerprints, language, lines, mixing, pieces, quality, ranked, simhash, substrings, token_counts, token_files, warc

_MODULES = [token_counts, quality, simhash, lines, pieces, token_files, mixing, warc, fingerprints, substrings, conversations, language, ranked]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
