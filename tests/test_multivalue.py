from __future__ import annotations

import re

import pytest

from jobweave.operators.multivalue import SEPARATORS, parses_of, split_field, split_values
from jobweave.sources.tables import table

CASES = [
    ("a", ["a"]), ("a|b||c|", ["a", "b", "c"]), ("a、 b ；c", ["a", "b", "c"]), ('"x,y",z', ["x,y", "z"]), ('["p", "q / r"]', ["p", "q / r"]),
    ("“批发/零售”、互联网", ["批发/零售", "互联网"]), ("'a;b' / c", ["a;b", "c"]), ('"Retail ""Express""";z', ['Retail "Express"', "z"]),
    ("front-end dev", ["front-end dev"]), ("node.js\ta b\n", ["node.js", "a b"]), ("dup,dup,dup", ["dup", "dup", "dup"]), (",,;", []), ("'tis", ["'tis"]), ('"open, x', ['"open', "x"]),
]


def test_fields(spark):
    rows = [(k, f) for k, (f, _) in enumerate(CASES)] + [(90, None), (91, ""), (92, "  \t "), (None, "n1,n2"), (93, "v" * 20_000), (94, "a,b"), (94, "a,b")]
    df = spark.createDataFrame(rows, "id int, field string").selectExpr("*", "1 as item_pos", "2 as row_id", "'c' as pieces")
    got: dict = {}
    for r in split_values(df, "id", "field", "t").collect():
        assert r["table_name"] == "t"
        got.setdefault(r["row_id"], []).append((r["item_pos"], r["item_value"]))
    for k, (field, want) in enumerate(CASES):
        assert sorted(got.get(k, [])) == list(enumerate(want, 1)), field
    assert not {90, 91, 92} & set(got)
    assert sorted(got[None]) == [(1, "n1"), (2, "n2")]
    assert got[93] == [(1, "v" * 20_000)]
    assert sorted(got[94]) == [(1, "a"), (1, "a"), (2, "b"), (2, "b")]
    assert split_values(df.limit(0), "id", "field").count() == 0


def test_parses():
    assert split_field('"a,b', frozenset(","), True) is None
    assert {tuple(p) for _, _, p in parses_of("a,b")} == {("a,b",), ("a", "b")}
    costs = {tuple(p): bits for _, bits, p in parses_of("a,b")}
    assert costs[("a", "b")] < costs[("a,b",)]


def test_every_subset_of_many_separators():
    field = "a/b c|d,e;f、g，h"
    present = [c for c in field if c in SEPARATORS]
    got = {tuple(p) for _, _, p in parses_of(field)}
    assert len(present) == 6 and len(got) == 2**6
    assert ("a/b c", "d", "e", "f", "g", "h") in got  # the slash stands bare, the others separate


def test_one_bare_separator_among_five(spark):
    """What the codebook knows as one value is not split at its slash."""
    rows = [(k, "TCP/IP") for k in range(500)] + [(1000, "TCP/IP|a1,b2;c3、d4")]
    known = [(2000 + k, v) for k, v in enumerate(["a1", "b2", "c3", "d4"] * 50)]
    got = split_values(spark.createDataFrame(rows + known, "id int, field string"), "id", "field").where("row_id = 1000")
    parsed = {tuple(p): b for _, b, p in parses_of("TCP/IP|a1,b2;c3、d4")}
    assert ("TCP/IP", "a1", "b2", "c3", "d4") in parsed
    assert [r["item_value"] for r in got.orderBy("item_pos").collect()][-4:] == ["a1", "b2", "c3", "d4"]


@pytest.mark.parametrize("name, column", [("skill", "aliases"), ("raw_job", "industry")])
def test_whole_columns_against_a_plain_splitter(spark, folder, name, column):
    """Every stored field against a splitter that takes all separators outside quotes."""

    def plain(field: str) -> list[str]:
        body = field.strip()
        body = body[1:-1] if body[:1] == "[" and body[-1:] == "]" else body
        token = re.compile(r'\s*(?:"((?:[^"]|"")*)"|\'([^\']*)\'|“([^”]*)”|([^|｜,，;；、/\t\n]*))\s*(?:[|｜,，;；、/\t\n]|$)')
        at, out = 0, []
        while at < len(body):
            m = token.match(body, at)
            value = next((g for g in m.groups() if g is not None), "").replace('""', '"').strip()
            out += [value] if value else []
            at = m.end() if m.end() > at else at + 1
        return out

    df = table(spark, "/root/testdata/sf0.01", name).select("id", column)
    want = {r["id"]: list(enumerate(plain(r[column]), 1)) for r in df.collect() if r[column] and plain(r[column])}
    got: dict = {}
    for r in split_values(df, "id", column).collect():
        got.setdefault(r["row_id"], []).append((r["item_pos"], r["item_value"]))
    assert {k: sorted(v) for k, v in got.items()} == want
