import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from siftwell import build_session  # noqa: E402

TESTDATA = pathlib.Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[4]", app="siftwell-tests", spark__sql__shuffle__partitions="4",
                            spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
                            spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def csv_file(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_text(text, encoding="utf-8")
        return str(path)
    return write


@pytest.fixture(scope="session")
def tables(spark):
    folder = TESTDATA / "sf0.001"
    if not folder.is_dir():
        pytest.skip("no driver tables here")
    return {p.stem: spark.read.parquet(str(p)) for p in folder.glob("*.parquet")}
