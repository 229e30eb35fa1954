"""Every query against its DuckDB SQL, over whole small tables."""

import duckdb
import pytest

from lethe.plans import registry, space, store_queries

from .rows import rows

DATA = "/root/testdata/sf0.001"
TABLES = "documents conversations events pages".split()


@pytest.fixture(scope="module")
def duck():
    session = duckdb.connect()
    for t in TABLES:
        session.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return session


@pytest.mark.parametrize("name", [*registry.QUERIES, *store_queries.QUERIES])
def test_same_rows_as_duckdb(spark, duck, name):
    queries, oracles = registry.QUERIES | store_queries.QUERIES, registry.ORACLES | store_queries.ORACLES
    got, want = queries[name](spark, DATA).toPandas(), duck.sql(oracles[name]).df()
    assert rows(got) == rows(want)
    assert len(want) or name not in store_queries.QUERIES


def test_conflicts_are_found(spark, duck, tmp_path):
    """The small tables have none, so three documents of two sources share a first chunk."""
    head = "x" * 4096
    frame = spark.createDataFrame([(0, head + "a", "en", "src0"), (1, head + "b", "en", "src1"), (2, head + "c", "en", "src0"), (3, "z", "en", "src2")], "doc_id long, text string, lang string, source string")
    frame.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = registry.QUERIES["unique_label_conflicts"](spark, str(tmp_path)).select("path", "pos").collect()
    assert sorted((r["path"], r["pos"]) for r in got) == [("doc/1", 0), ("doc/2", 0)]


def test_and_wrap_loses_what_the_store_loses(spark):
    """Files that share a chunk with the erased person can't be restored, by the plan and by the store."""
    modes = registry.QUERIES["restore_status"](spark, DATA).where("mode = 'and-wrap'").select("reason", "files").collect()
    kept = store_queries.QUERIES["store_restored_and_wrap"](spark, DATA).groupBy("reason").count().collect()
    assert sorted(map(tuple, modes)) == sorted(map(tuple, kept)) and dict(map(tuple, kept))["missing-key"]


def test_kinds_of_chunks(spark):
    """Chunks of the erased person, of others and of nobody, equal or not; none at all give no rows."""
    chunk = [("unique", "a", 4, "src0"), ("unique", "a", 4, "src0"), ("unique", "a", 4, "x"), ("unique", "a", 4, None), ("mixed", "a", 4, "x"), ("mixed", "b", 0, None)]
    frame = spark.createDataFrame(chunk, "file_class string, fp string, n long, subject string")
    got = sorted(map(tuple, space.kinds(frame).collect()))
    want = [
        ("mixed", False, False, False, 16, 1), ("mixed", False, False, True, 20, 1), ("mixed", True, False, False, 16, 1), ("mixed", True, False, True, 20, 1),
        ("unique", False, False, False, 20, 1), ("unique", False, False, True, 20, 1), ("unique", False, True, False, 40, 2), ("unique", True, True, True, 20, 1),
    ]
    assert got == want and not space.kinds(frame.limit(0)).collect()


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("missing", [("lethe.llm",), ("lethe.llm", "corpus_pipeline"), ("xxhash", "regex")])
def test_entry_without_the_training_operators(monkeypatch, missing):
    import importlib
    import sys

    import __spark_entry__ as entry

    for name in [n for n in sys.modules if n.startswith("lethe.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr("lethe.llm", raising=False)
    for name in missing:
        monkeypatch.setitem(sys.modules, name, None)
    try:
        bare = importlib.reload(entry)
        assert set(bare.queries()) == set(registry.QUERIES | store_queries.QUERIES) and set(bare.oracle_sql()) <= set(bare.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_each_query_has_a_store_of_its_own(spark):
    """What a query costs and gives doesn't depend on those that ran before it."""
    one, two = (store_queries.store(spark, DATA, "drop") for _ in range(2))
    assert one.tables.root != two.tables.root
    two.erase("src2")
    assert one.files("src2").where("ok").count() and not two.files("src2").where("ok").count()
