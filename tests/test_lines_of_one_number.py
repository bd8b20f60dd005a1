"""Lines of one order and number are items each: they share a doc_id, and joins must not mix them."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark import queries as Q

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def doubled(tmp_path_factory):
    """The tables with each line twice, the second of another discount, quantity and supplier's nation."""
    home = tmp_path_factory.mktemp("doubled")
    for t in Q.PANEL:
        x = pq.read_table(f"{D}/{t}.parquet")
        if t == "lineitem":
            again = x.to_pandas().assign(l_discount=lambda p: 0.1 - p.l_discount, l_quantity=lambda p: 51 - p.l_quantity)
            again.loc[again.index % 3 == 0, "l_suppkey"] = again.l_suppkey.iloc[0]
            x = pa.concat_tables([x, pa.Table.from_pandas(again, x.schema, preserve_index=False)])
        pq.write_table(x, home / f"{t}.parquet")
    return str(home)


def agrees(spark, d, name):
    duck = duckdb.connect()
    for t in Q.PANEL:
        duck.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    plain = lambda rows: sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)
    got, wanted = plain(Q.QUERIES[name](spark, d).collect()), plain(duck.execute(Q.ORACLE_SQL[name]).fetchall())
    assert got == wanted and wanted


def test_entity_items(spark, doubled):
    agrees(spark, doubled, "entity_items")


def test_entity_narratives(spark, doubled):
    agrees(spark, doubled, "entity_narratives")
