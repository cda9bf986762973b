"""Queries of the llm subpackage."""

from __future__ import annotations

from tessera.llm import matching, mixing, packing, truncation

QUERIES = {
    "p1_found": matching.found,
    "p1_pairs": matching.pairs,
    "p6_bins": packing.document_bins,
    "p6_fill": packing.fill_report,
    "p7_copies": mixing.copies,
    "p7_shares": mixing.shares,
    "p8_found": truncation.found,
    "p8_rates": truncation.rates,
}
#: None: learned, tokenised or corpus-statistical results have no SQL; they're tested in tests/llm.
SQL: dict[str, str] = {}
