"""Readers and writers on small files."""

import pytest
from pyspark.sql import functions as F

from wordloom.sources import binary, delimited, lines as ln


@pytest.fixture
def write(tmp_path):
    def run(name, text):
        path = tmp_path / name
        path.write_text(text, encoding="utf8")
        return str(path)
    return run


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_dialects(spark):
    data = [("t", 1, "a\tb,c"), ("t", 2, "d\te"), ("s", 1, "a;b;c"), ("s", 2, ""), ("s", 3, "a;b;c,d"), ("n", 1, "plain"),
            ("x", 1, "a,b|c|d"), ("x", 2, "a|b|c")]
    lines = spark.createDataFrame(data, "file string, line_no int, value string")
    assert rows(delimited.sniff_dialect(lines)) == [("n", ","), ("s", ";"), ("t", "\t"), ("x", "|")]


def test_header_rules():
    ok = [["label", "text"], ["a", "b"]]
    assert delimited.looks_like_header(ok)
    assert not delimited.looks_like_header(ok[:1])
    assert not delimited.looks_like_header([["a", "a"], ["b", "c"]])
    assert not delimited.looks_like_header([["a", " "], ["b", "c"]])
    assert not delimited.looks_like_header([["a", "x" * 46], ["b", "c"]])
    assert not delimited.looks_like_header([["1", "-2.5"], ["b", "c"]])
    assert delimited.looks_like_header([["1", "1.2.3"], ["b", "c"]])


def test_plain_csv_with_header(spark, write):
    got = delimited.read_delimited(spark, write("a.csv", 'label,text\nspam,"win, ""now"""\n\nham,hi\n,\n'))
    assert got.had_header and not got.recovered_from_quotes and got.delimiter == ","
    assert rows(got.data) == [("ham", "hi"), ("spam", 'win, "now"')]


def test_records_over_several_lines(spark, write):
    got = delimited.read_delimited(spark, write("a.csv", 'label,text\nspam,"two\nlines, here"\nham,hi\n'))
    assert not got.recovered_from_quotes
    assert rows(got.data) == [("ham", "hi"), ("spam", "two\nlines, here")]


@pytest.mark.parametrize("stray", ['ham\t"unclosed here\n', 'ham\t"one here\nham\t"two there\n'])
def test_stray_quotes_lose_no_row(spark, write, stray):
    body = "spam\tsee this now\n" + stray + "spam\tthe end of it\n"
    got = delimited.read_delimited(spark, write("a.csv", "spam\ta sentence much longer than any column name would ever be\n" + body))
    assert not got.had_header and got.recovered_from_quotes and got.delimiter == "\t"
    assert got.data.columns == ["column_1", "column_2"]
    assert got.data.count() == 1 + body.count("\n")


def test_clean_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "hi", ok'), ("b", "two\nlines"), ("c", None)], "id string, text string")
    path = str(tmp_path / "out")
    delimited.write_clean_csv(df, path)
    assert rows(delimited.read_delimited(spark, path).data) == [("a", 'say "hi", ok'), ("b", "two\nlines"), ("c", "")]


def test_text_lines(spark, write):
    assert rows(ln.read_text_lines(spark, write("a.txt", " one \n\n two\n"))) == [("one",), ("two",)]


def test_multilabel_detection():
    named = ln.detect_multilabel('a,b,"this is the text"', "1,0,hello there")
    assert named.label_columns == ["a", "b"] and named.has_header
    bare = ln.detect_multilabel("1\t0\tsome text that is long enough", "0\t0\tx")
    assert bare.label_columns == ["label0", "label1"] and not bare.has_header and bare.separator == "\t"
    assert ln.detect_multilabel("just a sentence", None) is None
    assert ln.detect_multilabel("1,0,short", None) is None


def test_multilabel_file(spark, write):
    path = write("m.txt", 'a,b,"the text of this document"\n1,0,"one, two"\n0,0,three\n1,1,\n')
    assert rows(ln.read_multilabel_txt(spark, path)) == [("one, two", 1, 0), ("three", 0, 0)]
    assert ln.read_multilabel_txt(spark, write("p.txt", "plain text\nmore\n")) is None


def test_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(binary.docx_bytes(["first", " ", "second\ttab"]))
    (tmp_path / "b.xlsx").write_bytes(binary.xlsx_bytes([["label", "text"], ["x", "a & b"]]))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.pdf").write_bytes(b"%PDF page one")
    pdf = {"pdf": lambda content: [[content.decode()[5:]]]}
    got = binary.read_binary_docs(spark, str(tmp_path), pdf).withColumn("name", F.substring_index("path", "/", -1))
    good = rows(got.filter("error IS NULL").select("name", "row", "text"))
    assert good == [("a.docx", 1, "first"), ("a.docx", 2, "second\ttab"), ("b.xlsx", 1, "label\ttext"),
                    ("b.xlsx", 2, "x\ta & b"), ("d.pdf", 1, "page one")]
    assert [r.name for r in got.filter("error IS NOT NULL").collect()] == ["c.docx"]


def test_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    for kind in ("json", "parquet"):
        delimited.write_results(df, str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 1
    with pytest.raises(ValueError):
        delimited.write_results(df, str(tmp_path / "x"), "xml")


def test_each_file_has_its_own_dialect(spark, tmp_path):
    """A header, or a delimiter, of one file says nothing about another."""
    (tmp_path / "a.csv").write_text("label,text\nspam,one\nham,two\n")
    (tmp_path / "b.csv").write_text("spam,a sentence much longer than any column name would ever be\nham,four\n")
    (tmp_path / "c [x].csv").write_text("label;text\nham;five, six\n")
    (tmp_path / "d.csv").write_text("")
    got = delimited.read_delimited(spark, str(tmp_path))
    assert sorted(r.text for r in got.data.collect()) == [
        "a sentence much longer than any column name would ever be", "five, six", "four", "one", "two"]
    assert got.data.columns == ["label", "text"]


def test_no_files_with_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert delimited.read_delimited(spark, str(tmp_path)).data.count() == 0


def test_headers_do_not_depend_on_other_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n7,one\n8,two\n")
    (tmp_path / "b.csv").write_text("sku,price\nx,3\n")
    (tmp_path / "c.csv").write_text("1,2\n3,4\n")
    (tmp_path / "d.csv").write_text("sku,price\n")
    got = delimited.read_delimited(spark, str(tmp_path)).data
    assert set(got.columns) == {"id", "name", "sku", "price", "column_1", "column_2"}
    assert sorted((r.id, r.name, r.sku, r.price, r.column_1, r.column_2) for r in got.collect()) == [
        ("", "", "", "", "1", "2"), ("", "", "", "", "3", "4"), ("", "", "x", "3", "", ""),
        ("7", "one", "", "", "", ""), ("8", "two", "", "", "", "")]


def test_many_small_files_share_a_batch(spark, monkeypatch):
    """Results of files leave a task in batches of many rows; errors and empty files keep their places."""
    files = [(f"{i}.docx", bytes(binary.docx_bytes([f"a {i}", "b"] if i % 5 else []))) for i in range(30)] + [("x.docx", b"no zip"), ("y.odd", b"")]
    df = spark.createDataFrame(files, "path string, content binary").coalesce(1)
    get = lambda: sorted((r.path, r.row, r.text, r.error is None) for r in binary.extract_binary_docs(df).collect())
    whole = get()
    assert len(whole) == 24 * 2 + 2 and sum(not ok for *_, ok in whole) == 2
    monkeypatch.setattr(binary, "OUT_ROWS", 3)
    assert get() == whole
