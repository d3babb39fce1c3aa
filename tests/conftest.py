import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpusqa.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(8, partitions=4, memory="4g")
    if s.conf.get("spark.checkpoint.dir", None) is None:
        s.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
    yield s


@pytest.fixture(scope="session")
def docs(spark):
    """Make documents from texts: list of (lang, text) or text."""
    def make(items):
        rows = [(i, *(x if isinstance(x, tuple) else ("", x))) for i, x in enumerate(items)]
        return spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(4)

    return make
