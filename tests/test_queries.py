"""The registered queries against their SQL, over the smallest test tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ("detect_type_pages", "jsonl_select_k", "json_tree_shred", "row_to_brace", "row_to_clines", "html_links", "html_element_counts", "xpath_position", "xpath_union", "delete_xpath", "select_reverse", "entity_replace_tree", "annotate_offsets", "unquote_c", "get_int_octal_hex", "ixml_csv", "tokenize_brace", "xslt_group", "validate_enum", "lines_stream", "load_files", "read_lines", "literal_docs", "forced_type", "select_attributes", "relative_path", "single_match", "entity_named", "add_built_tree", "brace_coloured", "kinds_of_words", "text_functions", "ixml_cost_long", "ixml_recover", "ixml_yaml", "ixml_metar", "xslt_import_format", "validate_key", "huge_following", "stored_branches", "twig_huge", "table_set_attribute", "path_summary", "huge_json", "udtf_nodes", "line_numbers", "document_lookup", "regular_log")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_gives_what_its_sql_gives(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall())))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["jsonl_select_k", "delete_xpath", "replace_xpath", "add_root", "add_snippet", "set_attribute", "select_reverse", "entity_replace", "entity_delete", "char_entity", "entity_replace_tree", "html_delete_script", "html_title", "xpath_string_functions", "validate_int", "json_roundtrip"])
def test_changes_parse_a_text_once(spark, name):
    """One Arrow stage, and no shuffle of what it gives."""
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
