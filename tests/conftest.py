import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from turnwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=2)
    # Hundreds of tiny plans: compiling each of them would dominate the run.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    def make(*logs):
        rows = [r for log in logs for r in log.rows]
        return spark.createDataFrame(rows, "path string, line_no bigint, value string")

    return make


@pytest.fixture
def records(lines):
    from turnwise.operators.records import read_records

    return lambda *logs: read_records(lines(*logs))


@pytest.fixture
def session(records):
    from turnwise.operators.sessions import build_sessions
    from turnwise.session import materialize

    def one(*logs, **options):
        rows = build_sessions(materialize(records(*logs), "t"), **options).collect()
        return rows[0] if len(rows) == 1 else {r.path: r for r in rows}

    return one
