"""Queries of the corpus operators, as ``name -> (spark, folder) -> DataFrame``."""

from __future__ import annotations

from wachbuch.llm import addresses, linkage, mixing, scans, subjects, survivors, tokens
from wachbuch.session import table

QUERIES = {
    "p2_found": lambda s, d: survivors.found(table(s, d, "press_releases")),
    "p3_found": lambda s, d: scans.found(table(s, d, "raw_courts")),
    "p3_texts": lambda s, d: scans.repaired(table(s, d, "raw_courts")),
    "p5_found": lambda s, d: addresses.same_house(table(s, d, "press_releases")),
    "p7_found": lambda s, d: linkage.found(table(s, d, "court_matches"), table(s, d, "press_releases")),
    "p7_links": lambda s, d: linkage.link(table(s, d, "press_releases"), table(s, d, "court_matches")),
    "p8_ids": lambda s, d: tokens.encode(table(s, d, "documents")),
    "p9_mix": lambda s, d: mixing.positions(mixing.sized(table(s, d, "documents")), table(s, d, "mix_targets")),
    "p9_shares": lambda s, d: mixing.shares(mixing.sized(table(s, d, "documents")), table(s, d, "mix_targets")),
    "p10_found": lambda s, d: subjects.found(table(s, d, "documents"), table(s, d, "subject_labels"), table(s, d, "subject_areas")),
}
SQL: dict[str, str] = {}
