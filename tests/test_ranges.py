"""Files read by ranges of a few bytes, against parsers of whole files."""

import csv
import io
import random

import pyarrow as pa
import pytest

from grove.sources import delimited, ranges


@pytest.fixture
def small_ranges(spark):
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def plain(text, sep, n):
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""), delimiter=sep) if r]
    return [(i, *(r + [""] * n)[:n]) for i, r in enumerate(rows, 1)]


def noise(seed, n, pieces):
    rng = random.Random(seed)
    return "".join(rng.choice(pieces) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_effects_of_lines_are_those_of_the_parser(seed):
    """The state and the rows after each line, for texts of any quotes and breaks."""
    for x in range(400):
        text = noise((seed, x).__hash__(), 14, ["a", "é", ";", '"', '""', "\n", "\n", "\r\n", "\r", " ", ';"', '"\n'])
        quoted, rows = False, 0
        for line in text.split("\n"):
            quoted, n = delimited.after(line, ";", quoted)
            rows += n
        assert rows + quoted == len(plain(text, ";", 1)), repr(text)


@pytest.mark.parametrize(("seed", "size"), [(0, 16), (1, 40), (2, 150), (3, 1000)])
def test_ranges_give_the_rows_of_a_whole_file(spark, tmp_path, small_ranges, seed, size):
    names = ["u", "v", "w"]
    cells = ["a", "é", "—", " x ", "", '"q"', '"two\nlines"', '"a ""b"" ; c"', '"\r\n\r\n"', 'in"side', '"done"more', '"' + "long\n" * 30 + '"', '""']
    rng = random.Random(seed)
    line = lambda: ";".join(rng.choice(cells) for _ in range(rng.randint(1, 4)))
    want = {}
    for x in range(4):
        text = ("﻿" if x % 2 else "") + "".join(line() + rng.choice(["\n", "\r\n", "\r", "\n\n", "\n \n"]) for _ in range(rng.randint(0, 120))) + rng.choice(["", "end;x", 'open;"one;\ntwo'])
        (tmp_path / f"f{x}.csv").write_bytes(text.encode())
        want[f"f{x}.csv"] = plain(text, ";", 3)
    small_ranges(size)
    pieces = ranges.scan_pieces(spark, str(tmp_path))
    assert pieces.select("path", "start").distinct().count() > len(want) or size == 1000
    rows = delimited.scan(spark, str(tmp_path), names, sep=";", header=False, ragged=True, untrimmed=tuple(names)).collect()
    assert sorted(tuple(r) for r in rows) == sorted(r for f in want.values() for r in f)
    small_ranges(1 << 20)
    assert ranges.whole_files(spark, str(tmp_path))
    rows = delimited.scan(spark, str(tmp_path), names, sep=";", header=False, ragged=True, untrimmed=tuple(names)).collect()
    assert sorted(tuple(r) for r in rows) == sorted(r for f in want.values() for r in f)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    path = tmp_path / "m.csv"
    path.write_text("baumart_bo,baumart_de,wikidata_id\n" + "".join(f'Acer {i},"a\nb ""{i}""",Q{i}\n' for i in range(20_000)))
    small_ranges(20_000)
    rows = delimited.scan_mapping(spark, str(path))
    assert rows.rdd.getNumPartitions() > 20
    got = rows.orderBy("line").collect()
    assert [tuple(r) for r in got] == [(i + 2, f"Acer {i}", f'a\nb "{i}"', f"Q{i}") for i in range(20_000)]


def test_contract_holds_in_every_range(spark, tmp_path, small_ranges):
    good = "baumart_bo,baumart_de,wikidata_id\n" + "".join(f"Rosa {i},Rose,Q{i}\n" for i in range(200))
    small_ranges(300)
    for text, said in ((good + 'short,"x\ny"\n', "invalid_row_format.*line 202"), ('"baumart\n' + "x" * 700 + '",b,c\n' + good, "invalid_header")):
        path = tmp_path / "bad.csv"
        path.write_text(text)
        with pytest.raises(Exception, match=said):
            delimited.scan_mapping(spark, str(path)).collect()
    path.write_text("")
    assert delimited.scan_mapping(spark, str(path)).count() == 0


def test_rows_behind_a_head_and_before_a_tail():
    lines = ['still open', 'closed";b', 'c;"d', 'e";', '', 'f;g', 'h;"open', 'on']
    place = delimited.Place(True, True, 7, 0)
    before, rest = delimited._behind_head(iter(lines), ";", place)
    contract = delimited.Contract(("x", "y"), ";", False, False)
    got = [r for b in contract.rows("f", delimited._broken(rest), before, place.open) for r in b.to_pylist()]
    assert [(r["line"], r["f"]) for r in got] == [(9, ["c", "d\ne"]), (10, ["f", "g"])]
    cut = [b for kind, held, n in delimited._split(iter(lines), ";", place) if kind == "rows" for b in held]
    assert cut == lines[2:6]


def test_pieces_by_range_of_mixed_batches():
    batch = lambda *rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["path", "start", "value"])
    batches = [batch(("a", 0, "1"), ("a", 0, "2"), ("a", 9, "3")), batch(), batch(("a", 9, "4"), ("b", 9, "5"))]
    assert [(k, list(v)) for k, v in ranges.by_range(iter(batches))] == [(("a", 0), ["1", "2"]), (("a", 9), ["3", "4"]), (("b", 9), ["5"])]
