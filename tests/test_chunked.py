"""CSV with line breaks in cells and large JSON arrays, cut into small blocks, against the standard library."""

import csv
import json
import random

import pytest

from tessera.sources import chunked, sinks


@pytest.fixture()
def small_blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


CELLS = ["plain", "", 'say "so"', "two\nlines", "\n\n", "a,b", '"', '""', "é\n\"x\",\n", "x" * 150, "{}", "tail ", '"\n"']


def test_quoted_csv(small_blocks, tmp_path):
    rng, want = random.Random(4), []
    for name in ("a", "b", "c"):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator="\n" if name != "b" else "\r\n")
            out.writerow(["k", "v\nw", "x"])
            for k in range(40 if name != "c" else 0):
                row = (k, rng.choice(CELLS), rng.choice(CELLS))
                out.writerow(row)
                want.append((str(row[0]), row[1], row[2]))
    got = chunked.read_quoted_csv(small_blocks, str(tmp_path), "k long, v string, x string")
    assert got.rdd.getNumPartitions() > 3
    assert sorted((str(r.k), r.v or "", r.x or "") for r in got.collect()) == sorted(want)
    assert all(r[chunked.BAD] is None for r in got.collect())


def test_bad_records_stay_visible(small_blocks, tmp_path):
    (tmp_path / "x.csv").write_text('k,v\n1,one\nno number,"two\nlines"\n3,three,too many\n\n4,\n5,nan\n')
    got = {r.k: r for r in chunked.read_quoted_csv(small_blocks, str(tmp_path), "k long, v string").collect()}
    assert got[1].v == "one" and got[4].v is None and got[1][chunked.BAD] is None
    assert got[None][chunked.BAD] == 'no number,"two\nlines"' and got[3][chunked.BAD] == "3,three,too many"
    (tmp_path / "x.csv").write_text("k,v\n")
    assert chunked.read_quoted_csv(small_blocks, str(tmp_path), "k long, v string").collect() == []


TEXTS = ['"}{', "\\", '\\"}', "]}[{", "", "é\n", "x" * 120, '"', "\\\\", "},{"]


@pytest.mark.parametrize("depth", [1, 2])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(small_blocks, tmp_path, depth, indent):
    rng, want = random.Random(depth), []
    for name, n in (("a", 30), ("b", 1), ("c", 0)):
        items = [{"id": k, "text": rng.choice(TEXTS), "sub": {"t": [rng.choice(TEXTS), {"u": rng.choice(TEXTS)}]}} for k in range(n)]
        body = items if depth == 1 else {"data": items, "meta": {"total": n, "note": "]}"}}
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=indent))
        want += [(x["id"], x["text"], x["sub"]["t"][0]) for x in items]
    got = chunked.read_json_array(small_blocks, str(tmp_path), "id long, text string, sub struct<t:array<string>>", depth)
    assert sorted((r.id, r.text, r.sub.t[0]) for r in got.collect()) == sorted(want)
    assert all(r[chunked.BAD] is None and r.source_path.endswith(".json") for r in got.collect())


def test_empty_cells_and_nul(small_blocks, tmp_path):
    rows = [(1, "", None), (2, None, ""), (3, 'x\0"y', '\0"'), (4, "\r", '"\r\n"'), (None, "", None), (None, None, None)]
    sinks.write_quoted_csv(small_blocks.createDataFrame(rows, "k long, v string, x string"), str(tmp_path / "out"))
    got = chunked.read_quoted_csv(small_blocks, str(tmp_path / "out"), "k long, v string, x string").collect()
    assert sorted(((r.k, r.v, r.x) for r in got), key=repr) == sorted(rows, key=repr)
    assert all(r[chunked.BAD] is None for r in got)


def test_blocks_cut_anew(small_blocks, tmp_path):
    (tmp_path / "x.csv").write_text("k,v\n" + "".join(f'{k},"two\nlines {k}"\n' for k in range(50)))
    got = chunked.read_quoted_csv(small_blocks, str(tmp_path), "k long, v string")
    small_blocks.conf.set("spark.sql.files.maxPartitionBytes", "61")  # as other executors do between two scans
    assert sorted((r.k, r.v) for r in got.collect()) == [(k, f"two\nlines {k}") for k in range(50)]
