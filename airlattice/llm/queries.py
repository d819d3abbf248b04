"""Queries of this subpackage. Token counts, text alignment and clustering are tested against brute force; SQL says what they
must keep to."""

from airlattice.llm import leakage, packing, subjects

QUERIES = {
    "p7_containers": packing.containers,
    "p7_fill": packing.fill,
    "p7_conserved": packing.conserved,
    "p8_found": leakage.found,
    "p9_found": subjects.found,
    "p9_composition": subjects.composition,
}
ORACLE: dict[str, str] = {
    "p7_conserved": "SELECT DISTINCT doc_id, TRUE AS whole, TRUE AS within FROM documents WHERE doc_id IS NOT NULL",
}
