import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import prose  # noqa: E402


@pytest.fixture(scope="session")
def odd():
    """Rows with each odd case: null and empty texts, blanks, short and long texts, copies, near copies, null and repeated ids."""
    base = prose(1, 300)
    other = base.split()
    other[150] = "changed"
    return [
        (1, base), (2, base), (3, " ".join(other)), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "one"), (9, "two words"), (10, prose(2, 30_000)), (11, "x" * 50_000), (12, "né 😀 " * 400),
        (13, "the the the " * 300), (20, base), (20, base), (21, prose(3, 200) + " " + base), (None, prose(4, 150)), (14, "!!! ??? ..."), (15, prose(5, 120) + "\n" + prose(5, 120)), (16, prose(6, 260)),
    ]
