import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldlens.session import local_session  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8, app="fieldlens-tests")
    # spark.checkpoint.dir comes from the session (spark-defaults); when it is
    # unset, fieldlens.session.checkpoint_dir registers a scratch folder itself.
    yield s
    s.stop()


def sf_dir(sf: str) -> str:
    return f"{TESTDATA}/sf{sf}"
