"""The training-data subpackage can be deleted: nothing else imports it, and the entry points stay whole."""

import pathlib

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_nothing_else_imports_it():
    for p in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "millrace.llm" not in p.read_text(encoding="utf-8"), p


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if pathlib.Path("/root/testdata/sf0.001").is_dir():
        df = entry.entry(spark)
        assert df.count() > 0 and df.columns == ["doc_id", "item_id", "both", "size_text", "size_item", "severity"]
