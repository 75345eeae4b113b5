"""Stored tables: made once for each state of their inputs and of the code, dropped when they are old."""

import os

from echoquorum.sources import store


def test_a_changed_input_gives_a_new_table(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")

    def n():
        return store.stored(spark, "sample", [f"file://{tmp_path}/in"], build, keep=2).count()

    spark.range(3).write.parquet(f"{tmp_path}/in/a/b")
    assert (n(), n(), len(built)) == (3, 3, 1)
    spark.range(4).write.parquet(f"{tmp_path}/in/a/c")  # two levels down
    assert (n(), n(), len(built)) == (7, 7, 2)
    spark.range(5).write.parquet(f"{tmp_path}/in/d")
    assert (n(), len(built)) == (12, 3)
    folder = f"{store.root(spark).removeprefix('file:').replace('///', '/')}/echoquorum/store/sample"
    assert len([f for f in os.listdir(folder) if not f.startswith(".")]) == 2


def test_other_code_makes_its_own_table(spark, tmp_path, monkeypatch):
    spark.range(2).write.parquet(f"{tmp_path}/in")
    made = [store.stored(spark, "versioned", [f"file://{tmp_path}/in"], lambda: spark.read.parquet(f"{tmp_path}/in")).inputFiles()]
    monkeypatch.setattr(store, "code_version", lambda: "other")
    made.append(store.stored(spark, "versioned", [f"file://{tmp_path}/in"], lambda: spark.read.parquet(f"{tmp_path}/in")).inputFiles())
    assert made[0] != made[1]


def test_a_slower_session_finds_the_table_there(spark, tmp_path):
    spark.range(6).write.parquet(f"{tmp_path}/in")
    inputs = [f"file://{tmp_path}/in"]

    def slow():  # another session makes the table meanwhile
        store.stored(spark, "raced", inputs, lambda: spark.read.parquet(f"{tmp_path}/in"))
        return spark.read.parquet(f"{tmp_path}/in")

    assert store.stored(spark, "raced", inputs, slow).count() == 6
    assert store.stored(spark, "raced", inputs, slow).count() == 6
