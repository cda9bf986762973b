"""All queries of the core with the SQL that must give the same rows."""

from __future__ import annotations

from tessera.operators import dedup, history, instants, spatial_join
from tessera.plans import changes, landed, parsing, reads, reasoning, spatial, writes

QUERIES = {
    "p2_found": history.found,
    "p3_found": dedup.found,
    "p4_found": spatial_join.found,
    "p5_found": instants.found,
    **reads.QUERIES,
    **writes.QUERIES,
    **spatial.QUERIES,
    **reasoning.QUERIES,
    **parsing.QUERIES,
    **landed.QUERIES,
    **changes.QUERIES,
}
SQL = {
    "p2_found": history.FOUND_SQL,
    "p3_found": dedup.FOUND_SQL,
    "p4_found": spatial_join.FOUND_SQL,
    "p5_found": instants.FOUND_SQL,
    **reads.SQL,
    **writes.SQL,
    **spatial.SQL,
    **reasoning.SQL,
    **parsing.SQL,
    **landed.SQL,
    **changes.SQL,
}
flagship = reads.flagship
