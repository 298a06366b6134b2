import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from rankflow.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "rankflow-tests", **{"spark.sql.shuffle.partitions": "2"})


@pytest.fixture()
def fresh_dir(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)
