import os
import signal
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


#: Seconds a test may take, so that one plan can't end the whole run.
LONGEST = 400


@pytest.fixture(autouse=True)
def time_bound():
    def late(*_):
        raise TimeoutError(f"longer than {LONGEST} s")
    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(LONGEST)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)


@pytest.fixture(scope="session")
def spark():
    from agora.plans import offline  # noqa: F401  (registers the rule-based annotator)
    from agora.session import get_session
    s = get_session("local[4]", shuffle_partitions=4, app_name="agora-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_small():
    from tests.oracle_compare import duck
    return duck(SMALL)
