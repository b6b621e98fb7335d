import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tablewright.session import get_session  # noqa: E402
from tablewright.table import OrderKey, Table, hidden_name  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="tw-tests-")
    return get_session("local[8]", shuffle_partitions=8,
                       extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                              "spark.sql.warehouse.dir": os.path.join(scratch, "wh")})


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="tw-run-")


def make_table(spark, rows, schema, ordered=True):
    """Table from inline rows; order = position in ``rows`` (like the
    reference's arrays)."""
    df = spark.createDataFrame(rows, schema)
    if not ordered:
        return Table(df)
    pos = hidden_name("pos")
    indexed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{pos} long, " + schema)
    return Table(indexed.select(*df.columns, pos), (OrderKey(pos),))


def rows_of(table, ordered=True):
    from tablewright.table import as_table
    t = as_table(table)
    return [tuple(r) for r in t.to_df(ordered=ordered).collect()]
