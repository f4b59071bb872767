"""The paged source: offsets, retries, required keys, pages that aren't whole."""

import json

import pytest

from ledgerline.sources import paged

SCHEMA = "id bigint, name string, value double"


def write(folder, offset, rows, total, records="data"):
    (folder / f"page-{offset}.json").write_text(json.dumps({"total": total, records: rows}))


def rows(first, last):
    return [{"id": i, "name": f"n{i}", "value": i / 2, "more": [1]} for i in range(first, last)]


def test_every_page_is_a_partition(spark, tmp_path):
    for offset in (0, 4, 8):
        write(tmp_path, offset, rows(offset, min(offset + 4, 10)), 10)
    df = paged.read_pages(spark, str(tmp_path), SCHEMA, 4, ["id"])
    assert df.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, df.collect())) == [(i, f"n{i}", i / 2) for i in range(10)]


def test_pages_written_from_a_table_are_the_table(spark, tmp_path):
    df = spark.range(23).selectExpr("id * 3 as id", "concat('n', id) as name", "cast(id as double) as value")
    paged.write_pages(df, "id", f"file://{tmp_path}/p", 5)
    got = paged.read_pages(spark, f"file://{tmp_path}/p", SCHEMA, 5, ["id", "name"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect())) and got.rdd.getNumPartitions() == 5
    paged.write_pages(df.where("false"), "id", f"file://{tmp_path}/none", 5)
    assert paged.read_pages(spark, f"file://{tmp_path}/none", SCHEMA, 5).collect() == []


@pytest.mark.parametrize("spoil, said", [
    (lambda p: (p / "page-4.json").unlink(), "page at 4"), (lambda p: (p / "page-4.json").write_text("{"), "page at 4"),
    (lambda p: write(p, 4, rows(4, 7), 8), "3 rows of 4"), (lambda p: write(p, 4, rows(4, 8), 9), "changed"),
    (lambda p: write(p, 4, [*rows(4, 7), {"name": "x"}], 8), "lacks id"), (lambda p: write(p, 4, rows(4, 8), 8, "other"), "lacks data"),
])
def test_half_an_answer_is_an_error(spark, tmp_path, spoil, said):
    write(tmp_path, 0, rows(0, 4), 8)
    write(tmp_path, 4, rows(4, 8), 8)
    spoil(tmp_path)
    with pytest.raises(Exception, match=said):
        paged.read_pages(spark, str(tmp_path), SCHEMA, 4, ["id"], retries=1, pause=0.01).collect()


def test_a_page_is_asked_for_again(tmp_path, monkeypatch):
    reader = paged.PagedReader(paged.StructType.fromDDL(SCHEMA), {"path": str(tmp_path), "pagelength": "4", "retries": "3", "pause": "0"})
    write(tmp_path, 0, rows(0, 2), 2)
    asked = []

    def failing(path):
        asked.append(path)
        if len(asked) < 3:
            raise OSError("busy")
        return original(path)

    original = paged._store
    monkeypatch.setattr(paged, "_store", failing)
    assert reader.fetch(0)["total"] == 2 and len(asked) == 3
