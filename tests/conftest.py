import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))

from docloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", "docloom-tests", **{"spark__sql__shuffle__partitions": "4"})
