"""Columns of a user that are named like those that the operators work with go through as they are."""

import pytest
from pyspark.sql import functions as F

from parchment.llm import mixing, neardup
from parchment.llm.quality_rules import quality_rules

NAMES = {
    "quality_rules": ["q_host", "q_text", "q_lines", "q_removed", "q_row", "q_whole", "line", "copies", "n_docs", "x"],
    "mix_documents": ["m_id", "m_source", "m_size", "m_taken", "m_slots", "m_copy", "m_words", "m_row", "m_text", "m_key", "m_from", "src", "slot", "size"],
    "drop_near_duplicates": ["_nd_id", "_nd_text", "_nd_kept", "_nd_place", "_nd_row", "_nd_doc", "_nd_order", "t", "key", "component_id", "a.b"],
}
OPERATORS = {"quality_rules": quality_rules, "mix_documents": mixing.mix_documents, "drop_near_duplicates": neardup.drop_near_duplicates}


@pytest.mark.parametrize("name", NAMES)
def test_columns_go_through(docs, name):
    plain = docs.select("doc_id", "text", "source")
    named = plain.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in NAMES[name]})
    without, given = OPERATORS[name](plain), OPERATORS[name](named)
    assert [c for c in given.columns if c not in NAMES[name]] == without.columns and set(NAMES[name]) <= set(given.columns)
    rows = given.collect()
    assert rows and all(r[c] == c + str(r["doc_id"]) for r in rows for c in NAMES[name])
    assert sorted(repr(tuple(r[c] for c in without.columns)) for r in rows) == sorted(repr(tuple(r)) for r in without.collect())
