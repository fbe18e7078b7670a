"""Registered queries of the operators for training data."""

from __future__ import annotations

from quillgraph.llm import bpe, cooccurrence, formatting, language, packing, similar_sets, survivors
from quillgraph.tables import table

QUERIES = {
    "p1_found": lambda s, d: cooccurrence.reference_list_pairs(table(s, d, "citation"), 6, 4).selectExpr(
        "a AS paper_a", "b AS paper_b"
    ),
    "p1_pairs": lambda s, d: cooccurrence.reference_list_pairs(table(s, d, "citation")),
    "p2_found": lambda s, d: formatting.found(table(s, d, "paper"), table(s, d, "raw_record")),
    "p2_papers": lambda s, d: formatting.collapse(formatting.encoded_papers(table(s, d, "paper"))),
    "p2_records": lambda s, d: formatting.collapse(formatting.encoded_records(table(s, d, "raw_record"))),
    "p3_found": lambda s, d: survivors.best_papers(table(s, d, "paper"), table(s, d, "paper_identifier")).select(
        "group_id", "title_id", "year_id"
    ),
    "p3_records": lambda s, d: survivors.best_records(table(s, d, "paper"), table(s, d, "paper_identifier")),
    "p5_found": lambda s, d: similar_sets.similar_reference_lists(table(s, d, "citation"), 0.6)
    .pairs()
    .selectExpr("a AS paper_a", "b AS paper_b"),
    "p5_lists": lambda s, d: similar_sets.similar_reference_lists(table(s, d, "citation"), 0.6).summary(),
    "p6_ids": lambda s, d: bpe.encode_column(table(s, d, "documents")),
    "p7_containers": lambda s, d: packing.packed_documents(table(s, d, "documents")),
    "p8_found": lambda s, d: language.found(table(s, d, "documents"), table(s, d, "language_sample")),
    "p8_stretches": lambda s, d: language.label(table(s, d, "documents"), table(s, d, "language_sample")),
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    from quillgraph.llm.sql import SQL

    return dict(SQL)
