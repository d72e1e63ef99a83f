"""All queries of the text operators, and their DuckDB SQL where SQL can express them."""

from sensorframe.llm import chat_format, decontaminate, fingerprints, language_id, line_dedup, near_duplicates, packing, pii, quality, runs, secrets, spelling, warc

_MODULES = [fingerprints, secrets, chat_format, packing, warc, language_id, line_dedup, near_duplicates, decontaminate, quality, pii, spelling, runs]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
