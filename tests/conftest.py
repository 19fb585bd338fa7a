import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tradeaxis.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": 4,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def dec(text) -> Decimal | None:
    return None if text is None else Decimal(str(text)).quantize(Decimal("0.000000001"))


def rows(df, *columns):
    """Rows as tuples in a stable order; values compare by text, so NULLs sort too."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: tuple(map(str, r)))
