import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from seriesspark.session import build_session, checkpoint_dir
    s = build_session("local[4]", 8, app_name="seriesspark-tests",
                      extra={"spark.driver.memory": "4g"})
    if not s.conf.get("spark.checkpoint.dir", None):
        checkpoint_dir(s, tempfile.mkdtemp(prefix="ss-ckpt-"))
    yield s
