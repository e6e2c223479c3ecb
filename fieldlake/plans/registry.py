"""The engine's queries and their SQL."""

from fieldlake.plans import applied, motion, spectra, statistics

QUERIES = {**spectra.QUERIES, **statistics.QUERIES, **motion.QUERIES, **applied.QUERIES}
SQL = {**spectra.SQL, **statistics.SQL, **motion.SQL, **applied.SQL}
