"""Every query over the reference's own operators, with its SQL."""

from smframe.plans import more_queries, reader_queries, record_queries, relational_queries, rupture_queries, source_queries, waveform_queries

MODULES = (waveform_queries, relational_queries, more_queries, record_queries, reader_queries, source_queries, rupture_queries)
QUERIES: dict = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLE.items()}
