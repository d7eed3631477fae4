import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tapelens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SWAP = "token_mint string, signer string, side string, sol_amount double, token_amount double, ts long, slot long, price_usd double, tx_signature string, created_at long, graduated_at long"


@pytest.fixture
def tape(spark):
    """Builds a tape of one coin from (ts, side, signer, sol, price) rows with the anchor at zero."""
    def make(rows, mint="m"):
        data = [(mint, w, side, float(sol), 1.0, ts, ts, float(px), f"{i:06d}", 0, 0) for i, (ts, side, w, sol, px) in enumerate(rows)]
        return spark.createDataFrame(data, SWAP)
    return make
