"""Encoders: few classes by map, many by join, unseen and missing values."""

import pytest

from quarry.operators import features as fe


@pytest.mark.parametrize("few", [0, 3, 64])
def test_codes_by_map_and_by_join(spark, monkeypatch, few):
    monkeypatch.setattr(fe, "FEW_CLASSES", few)
    schema = "ID int, State string, Source string, State_enc int"
    seen = [(i, f"s{i % 9}", None if i % 4 == 0 else "ab"[i % 2], -1) for i in range(40)]
    classes = fe.fit_encoders(spark.createDataFrame(seen, schema), ["State", "Source"])
    rows = [(1, "s0", "a", 5), (2, "s8", None, 5), (3, "new", "b", 5), (4, None, "c", 5)]
    out = fe.apply_encoders(spark.createDataFrame(rows, schema), classes)
    assert out.columns == ["ID", "State", "Source", "State_enc", "Source_enc"]
    got = {r["ID"]: (r["State_enc"], r["Source_enc"]) for r in out.collect()}
    assert got == {1: (0, 0), 2: (8, 2), 3: (9, 1), 4: (9, 3)}  # 'nan' is the third class of Source, unseen ones the class count
    assert fe.apply_encoders(spark.createDataFrame(rows, schema).limit(0), classes).count() == 0
