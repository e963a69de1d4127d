from __future__ import annotations

import pytest

from opsdeck.session import share_code


@pytest.fixture(autouse=True)
def code(spark):
    share_code(spark)
