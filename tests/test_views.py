"""Derived views on odd texts."""

import duckdb

from corpuslake import plans


def test_lines_are_stripped_as_in_their_sql(spark, tmp_path):
    odd = ["\x0bled by a vertical tab", "ended by one\x0b", "  blanks \t", "kept \u2028", "last \x85", "\x0b", "   "]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.execute("INSERT INTO documents VALUES (2, ?, 'en', 'a', 1)", ["\n".join(odd * 3)])
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    got = plans.QUERIES["t7_lex_references"](spark, str(tmp_path)).select("document_id", "literal", "start_offset").collect()
    want = con.sql(f"SELECT document_id, literal, start_offset FROM ({plans.ORACLE_SQL['t7_lex_references']})").fetchall()
    assert want and sorted(map(tuple, got)) == sorted(want)
