import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gridweft.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tables of a few rows: compiling their plans would take longer than running them.
    return local_session("tests", cores=4, shuffle_partitions=2, spark__sql__codegen__wholeStage="false")
