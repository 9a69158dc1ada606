import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from homelens.session import build_session, share_code

    session = build_session("4", spark__sql__shuffle__partitions="4", spark__checkpoint__dir="file://" + str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    share_code(session)
    return session
