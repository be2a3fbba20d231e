import csv
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.plans.errors import RequestError
from tallyframe.sources import delimited, tabular
from tests.conftest import SF


def plain(data: bytes, sep=","):
    """All records at once, as one task would read them."""
    for encoding in ("utf-8-sig", "cp950", "gb18030"):
        try:
            text = data.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    csv.field_size_limit(2**30)
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=sep))


@pytest.fixture()
def small_splits(spark):
    """Splits of so many bytes while a test runs."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    kept = {n: spark.conf.get(n) for n in names}
    yield lambda n: [spark.conf.set(names[0], str(n)), spark.conf.set(names[1], "0")]
    for n, v in kept.items():
        spark.conf.set(n, v)


def read(spark, path):
    df = tabular.read_csv(spark, str(path))
    return df.columns, sorted((tuple(r) for r in df.collect()), key=str)


def expected(data: bytes):
    rows = plain(data)
    body = [r for r in rows[1:] if any(c.strip() for c in r)]
    return rows[0], sorted((tuple((r + [None] * len(rows[0]))[: len(rows[0])]) for r in body), key=str)


ROWS = [("a", "b", "c")] + [(str(i), f'li"ne{i}\nand, "more"\n\n"', "x" * (i * 37 % 90) + ("\r\n" if i % 3 else "")) for i in range(60)] + [("end", "", "é字 '")]


def written(rows, encoding="utf-8", quoting=csv.QUOTE_MINIMAL):
    out = io.StringIO(newline="")
    csv.writer(out, quoting=quoting).writerows(rows)
    return out.getvalue().encode(encoding)


@pytest.mark.parametrize("size", [61, 97, 256, 1000, 10**6])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp950", "gb18030"])
def test_records_across_splits(spark, tmp_path, small_splits, size, encoding):
    rows = [r[:2] + (r[2].replace("é", "e"),) for r in ROWS] if encoding == "cp950" else ROWS
    data = written(rows, encoding)
    (tmp_path / "t.csv").write_bytes(data)
    small_splits(size)
    assert read(spark, tmp_path / "t.csv") == expected(data)


@pytest.mark.parametrize("size", [40, 10**6])
@pytest.mark.parametrize("text", ['a,b\n1,"open to the end\nof, the file\n', 'a,b\n5" pipe,2\n"x"y,"z""\n",3\n', 'a,b\r1,2\r"x\ry",3\r', 'a,b\n\n\n1,2\n\n"\n\n\n",3\n', 'a,b\n' + '"' + "long\n" * 60 + '",1\n2,3\n'])
def test_odd_quotation_marks(spark, tmp_path, small_splits, text, size):
    (tmp_path / "t.csv").write_bytes(text.encode())
    small_splits(size)
    # the line feed that ends a file is no part of a cell, even if its quotation never ends
    assert read(spark, tmp_path / "t.csv") == expected(text.removesuffix("\n").encode())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('ab",\r\n', max_size=12), max_size=6))
def test_line_states_follow_the_reader(lines):
    """Behind each line the state says whether the reader would go on with the record; the reader is asked by what a mark behind it becomes."""
    states, state = delimited.LineStates(","), False
    for i, line in enumerate(x.replace("\n", "") for x in lines):
        state = states.after(line.encode(), state)
        text = "\n".join(x.replace("\n", "") for x in lines[: i + 1]) + "\nMARK"
        last = list(csv.reader(io.StringIO(text, newline="")))[-1]
        assert state == (last != ["MARK"])


def test_documents_in_many_splits(spark, tmp_path, small_splits):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()]
    data = written([("doc_id", "text", "lang"), *docs])
    (tmp_path / "t.csv").write_bytes(data)
    small_splits(20_000)
    assert read(spark, tmp_path / "t.csv")[1] == sorted(((str(i), t or "", g or "") for i, t, g in docs), key=str)


def test_folders_and_what_is_refused(spark, tmp_path, small_splits):
    (tmp_path / "d").mkdir()
    for i in range(3):
        (tmp_path / "d" / f"{i}.csv").write_text(f"Report\n\na,b\n{i},\"x\ny\"\n")
    assert read(spark, tmp_path / "d") == (["a", "b"], [("0", "x\ny"), ("1", "x\ny"), ("2", "x\ny")])
    (tmp_path / "d" / "3.csv").write_text("Report\n\na,c\n1,2\n")
    with pytest.raises(Exception, match="another header"):
        tabular.read_csv(spark, str(tmp_path / "d")).collect()
    (tmp_path / "bad.csv").write_bytes(b"a,b\n\xff\xff,\x80\n")
    with pytest.raises(RequestError, match="none of"):
        tabular.read_csv(spark, str(tmp_path / "bad.csv"))
    with pytest.raises(RequestError, match="separator"):
        tabular.read_csv(spark, str(tmp_path / "bad.csv"), '"')
    (tmp_path / "wide.csv").write_text("head of a file," + "x" * 100 + "\n1,2\n" * 20)
    small_splits(50)
    with pytest.raises(RequestError, match="first split"):
        tabular.read_csv(spark, str(tmp_path / "wide.csv"))
