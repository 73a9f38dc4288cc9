import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))


@pytest.fixture(scope="session")
def spark():
    from wayfold.session import local_session
    from wayfold.storage import drop_scratch

    session = local_session("tests", 4, "6g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.maxMetadataStringLength", "4000")
    yield session
    drop_scratch(session)
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Sorted plain rows of a frame."""
    return lambda df, *columns: sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
