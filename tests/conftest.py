import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from boxwise.session import get_spark
    ckpt = tempfile.mkdtemp(prefix="boxwise-test-ckpt-")
    s = get_spark("local[4]", "boxwise-tests", {
        "spark.sql.shuffle.partitions": "8",
        "spark.checkpoint.dir": ckpt,
        "spark.driver.memory": "4g",
    })
    yield s
    s.stop()
