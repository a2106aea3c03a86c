import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from seepage.session import get_session
    s = get_session("local[4]", "seepage-tests", shuffle_partitions=4,
                    extra={"spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seepage-test-ckpt-"))
    yield s


SF = "/root/testdata/sf0.001"
