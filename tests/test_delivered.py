import random

import pytest

from sievewright.sources import delivered

HEADER = "id,heavy,fitness"


def lines_of(spark, root, **options):
    files = delivered.delivered_files(spark, f"file://{root}")
    return {(r["path"], r["line_no"]): r["line_text"] for r in delivered.delivered_lines(files, **options).collect()}


def test_a_stray_quote_breaks_one_line_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'{HEADER}\n1,ACD,5\n2,"ACD,5\n3,ACD,6\n4,ACE,7\n')
    got = lines_of(spark, tmp_path)
    assert got == {("a.csv", 1): HEADER, ("a.csv", 2): "1,ACD,5", ("a.csv", 3): '2,"ACD,5', ("a.csv", 4): "3,ACD,6", ("a.csv", 5): "4,ACE,7"}
    files = delivered.delivered_files(spark, f"file://{tmp_path}")
    inv = delivered.inventory_of(delivered.delivered_lines(files), files)
    assert sorted(r["raw_label"] for r in delivered.raw_records(delivered.delivered_lines(files), inv).collect()) == [5.0, 6.0, 7.0]


def test_open_quotes_at_the_end_and_quoted_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f'{HEADER}\n1,"A\nC,D\n",5\n2,ACD,"6\n')
    (tmp_path / "b.tsv").write_bytes(b"\xef\xbb\xbfheavy\tkd\r\nACD\t\xff\r\nACE\t2")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text('x\n"open\nno header\n')
    got = lines_of(spark, tmp_path)
    assert got == {
        ("a.csv", 1): HEADER, ("a.csv", 2): '1,"A\nC,D\n",5', ("a.csv", 3): '2,ACD,"6', ("b.tsv", 1): "heavy\tkd", ("b.tsv", 2): "ACD\t�", ("b.tsv", 3): "ACE\t2",
        ("d.csv", 1): "x", ("d.csv", 2): '"open', ("d.csv", 3): "no header",
    }


@pytest.mark.parametrize("size", [7, 40, 333])
def test_ranges_give_what_one_reader_gives(spark, tmp_path, size):
    rng = random.Random(size)
    cells = ["ACD", '"A\nC"', '"a ""b"" c"', "", '"x,y"', "é", '"']  # the last is a stray quote
    text = "note\n" + HEADER + "\n" + "\n".join(",".join(rng.choice(cells) for _ in range(rng.choice([3, 3, 3, 2]))) for _ in range(120))
    (tmp_path / "a.csv").write_text(text)
    (tmp_path / "b.csv").write_text(HEADER + "\n1,ACD,2")
    assert lines_of(spark, tmp_path, range_bytes=size) == lines_of(spark, tmp_path)


def test_a_lenient_reader_fills_and_drops_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text("heavy,fitness,LC,CDRH3,Target\nACD,1,ACE,CC,t1\nACD,2\nACE,3,ACD,C,t2,more\nAC1,4,,,\nACD,5,A1,,\n,6,,,\n")
    files = delivered.delivered_files(spark, f"file://{tmp_path}")
    lines = delivered.delivered_lines(files)
    inv = delivered.inventory_of(lines, files)
    rows = lambda **k: {r["raw_label"]: (r["heavy"], r["light"], r["cdrh3"], r["antigen_id"]) for r in delivered.raw_records(lines, inv, **k).collect()}
    assert rows() == {1.0: ("ACD", "ACE", "CC", "t1")}
    assert rows(lenient=True) == {1.0: ("ACD", "ACE", "CC", "t1"), 2.0: ("ACD", "", "", ""), 3.0: ("ACE", "ACD", "C", "t2"), 4.0: ("AC", "", "", ""), 5.0: ("ACD", "A", "", "")}
