"""Queries of the subpackage against their SQL forms."""

import pytest

from assayer.llm import oracle, queries

from ..conftest import SMALL
from ..test_oracle import TYPES, plain, sql  # noqa: F401


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_matches_sql(spark, sql, name):  # noqa: F811
    df = queries.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = sql.execute(oracle.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns)
                     for r in found.fetchall()), key=repr)
    assert mine == theirs
    types = {d[0]: str(d[1]) for d in found.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema} == types
