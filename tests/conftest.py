import os
import shutil
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from loomtext.session import session

    folder = tempfile.mkdtemp(prefix="loomtext-")
    s = session("local[8]", 8, spark__ui__enabled="false", spark__driver__memory="6g", spark__checkpoint__dir=folder)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
    shutil.rmtree(folder, ignore_errors=True)


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c
