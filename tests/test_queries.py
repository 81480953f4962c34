"""Every query with SQL gives the rows of its SQL."""

import pytest

from linkweave.plans import queries

from .conftest import DATA


def plain(rows, columns):
    def text(x):
        if x is None or x != x:
            return ""
        if isinstance(x, bool):
            return str(x)
        return f"{float(x):.6f}" if isinstance(x, (int, float)) else str(x)

    return sorted(tuple(text(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    found = duck.execute(queries.ORACLES[name])
    names = [c[0] for c in found.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    want = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
    assert plain([r.asDict() for r in df.collect()], columns) == plain(want, columns)
