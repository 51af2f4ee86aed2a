import pytest
from samples import DOCUMENTS, prose


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and repeated rows, and columns that operators use inside."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t\n", "en", "s", 4), (4, prose(1, 80), "en", None, 1),
        (4, prose(1, 80), "en", None, 1), (5, prose(1, 80), None, "s", None), (None, prose(2, 60), "en", "s", 1), (6, "x" * 5000, "en", "s", 5000),
    ]
    return spark.createDataFrame([(*r, i, [i], "t") for i, r in enumerate(rows)], DOCUMENTS + ", key long, fp array<long>, label string")
