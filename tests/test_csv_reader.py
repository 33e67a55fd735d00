import datetime

import pytest

from tablesight.sources.readers import read_table


def write(tmp_path, raw: bytes) -> str:
    p = tmp_path / "t.csv"
    p.write_bytes(raw)
    return str(p)


@pytest.mark.parametrize("raw, columns, rows", [
    (b"a,b\n1,x\nNA,y\n3,N/A\n", {"a": "bigint", "b": "string"}, [(1, "x"), (None, "y"), (3, None)]),
    (b'a,b\n1,"say ""hi"", ok"\n2,z\n', {"a": "bigint", "b": "string"}, [(1, 'say "hi", ok'), (2, "z")]),
    (b'a;b\n1;"x;y"\n2;"p,q"\n', {"a": "bigint", "b": "string"}, [(1, "x;y"), (2, "p,q")]),
    (b'a,b\n1,"two\nlines"\n2,one\n', {"a": "bigint", "b": "string"}, [(1, "two\nlines"), (2, "one")]),
    (b"city,n\n" + b"plain,1\n" * 60 + "Bogot\u00e1,2\n".encode("latin-1"), {"city": "string", "n": "bigint"}, None),
    ("city,n\n".encode() + b"plain,1\n" * 60 + "Bogot\u00e1,2\n".encode(), {"city": "string", "n": "bigint"}, None),
    (b"a\tb\n1.5\ttrue\n\tFalse\n", {"a": "double", "b": "boolean"}, [(1.5, True), (None, False)]),
    (b"d|v\n2024-01-02|1e3\nnull|-2\n", {"d": "timestamp", "v": "double"}, [(datetime.datetime(2024, 1, 2), 1000.0), (None, -2.0)]),
])
def test_csv(spark, tmp_path, raw, columns, rows):
    df = read_table(spark, write(tmp_path, raw))
    assert dict(df.dtypes) == columns
    got = [tuple(r) for r in df.collect()]
    if rows is None:
        assert len(got) == 61 and got[-1] == ("Bogot\u00e1", 2)
    else:
        assert got == rows
