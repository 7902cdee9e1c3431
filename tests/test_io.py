"""CSV reader: pandas-style missing-value sentinels and type inference."""

import os
import tempfile

from fairaudit.sources import io as IO


def test_read_csv_sentinels_and_types(spark):
    d = tempfile.mkdtemp(prefix="fairaudit-csv-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write("id,score,flag,grp,note\n")
        f.write("1,0.5,true,a,x\n")
        f.write("2,NA,false,None,y\n")
        f.write("3,,true,b,NaN\n")
        f.write("4,nan,,N/A,null\n")
    df = IO.read_csv(spark, path)
    assert dict(df.dtypes) == {"id": "bigint", "score": "double", "flag": "boolean", "grp": "string",
                               "note": "string"}
    rows = sorted(df.collect(), key=lambda r: r["id"])
    assert [r["score"] for r in rows] == [0.5, None, None, None]
    assert [r["grp"] for r in rows] == ["a", None, "b", None]
    assert [r["note"] for r in rows] == ["x", "y", None, None]
    assert [r["flag"] for r in rows] == [True, False, True, None]


def test_read_csv_empty_is_an_error(spark):
    import pytest
    d = tempfile.mkdtemp(prefix="fairaudit-csv-")
    path = os.path.join(d, "e.csv")
    with open(path, "w") as f:
        f.write("a,b\n")
    with pytest.raises(ValueError, match="empty"):
        IO.read_csv(spark, path)
