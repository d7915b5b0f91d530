"""CSV files read in blocks against the csv module, and the column form against both."""

import csv
import io
import random

import pytest

from quillspark.functions import formats
from quillspark.sources.csv_blocks import cut, scan_csv
from tests.helpers import column_values


def plain(text):
    rows = [[c.replace("\r\n", "<br>").replace("\r", "<br>").replace("\n", "<br>").replace("|", "\\|") for c in r] for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""))]
    rows = [r for r in rows if r and (len(r) > 1 or r[0].strip(" "))]
    line = lambda r: "| " + " | ".join((r + [""] * len(rows[0]))[: len(rows[0])]) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def sample(seed):
    rng, out = random.Random(seed), []
    for _ in range(rng.randint(1, 30)):
        row = []
        for _ in range(rng.randint(1, 4)):
            cell = "".join(rng.choice("aé| b7") for _ in range(rng.randint(1, 9)))
            if rng.random() < 0.5:
                cell = '"' + cell.replace("7", rng.choice(["\n", "\r\n", '""', ",", "\n\n"])) + '"' + rng.choice(["", "", " ", ' z"'])
            elif rng.random() < 0.1:
                cell = "x" + cell + '" q'
            row.append(cell)
        out.append(",".join(row) + rng.choice(["\n", "\r\n", "\n\n", "\n  \n"]))
    return ("﻿" if seed % 5 == 0 else "") + "".join(out)


FILES = {f"f+ {i}é.csv": sample(i) for i in range(12)}


@pytest.mark.parametrize("block", ["48", "300", "128m"])
def test_blocks_of_any_size_give_the_same_table(spark, folder, block):
    for name, text in FILES.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(text.encode())
    broken = {"open.csv": b'a,b\n1,"x\n' * 31, "bad.csv": b"a,b\n1,\xff\n", "empty.csv": b"\n  \n\n"}
    for name, data in broken.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = {}
        for r in scan_csv(spark, folder).orderBy("file", "row").collect():
            got.setdefault(r["file"].rsplit("/", 1)[1], []).append(r)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert set(got) == set(FILES) | set(broken)
    for name, text in FILES.items():
        assert [r["row"] for r in got[name]] == list(range(len(got[name])))
        assert "\n".join(r["markdown"] for r in got[name]) == plain(text)
    assert [(r["markdown"], r["error"]) for n in ("open.csv", "bad.csv", "empty.csv") for r in got[n]] == [
        (None, "csv error: quoted field without end"), (None, "text error: not valid UTF-8"), (None, "csv error: empty file"),
    ]


def test_the_column_form_gives_the_same_table(spark):
    got = column_values(spark, list(FILES.values()), lambda v: formats.csv_to_markdown(v)["markdown"])
    assert got == [plain(t) for t in FILES.values()]


def test_states_of_a_line():
    assert cut(b'a,"b', False) == ([], 0)
    assert cut(b'a,"b', True) == ([(0, 4)], -1)
    assert cut(b'x"\ry,"z', True) == ([(0, 2)], 3)
    assert cut(b'a\r"b""', False) == ([(0, 1)], 2)
    assert cut(b"", False) == ([(0, 0)], -1)
    assert cut(b'5" pipe,"x" ,3\r', False) == ([(0, 14)], -1)
