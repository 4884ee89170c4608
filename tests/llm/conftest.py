import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(autouse=True)
def _bounded_batches(spark):
    from feedloom.llm.common import prepare

    prepare(spark)
