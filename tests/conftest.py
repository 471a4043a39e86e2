import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from corpuslane.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build("local[4]", 4, "3g")


def rows(df):
    """Sorted rows as tuples."""
    return sorted(tuple(r) for r in df.collect())
