import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerlake.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="ledgerlake-tests")
    yield s
    s.stop()


G1_CSV = """AccNo,Date,MainDesc,Amount,Balance,Currency
3995,2024-01-01,Acme Ltd,-10.00,90.00,GBP
3995,2024-01-01,Payroll,100.00,190.00,GBP
3995,2024-01-15,Acme  PLC,-20.00,170.00,GBP
3995,2024-02-03,Acme,-30.00,141.00,GBP
5968,2024-02-03,Acme,-30.00,70.00,EUR
5968,2024-02-10,,0.00,70.00,GBP
5968,bad-date,Shop CD 1234,5,75.00,GBP
5968,2024-03-01,Shop CD 1234,"1,5",,GBP
"""


@pytest.fixture(scope="session")
def g1(spark, tmp_path_factory):
    from ledgerlake.sources import ingest

    d = tmp_path_factory.mktemp("g1")
    p = d / "g1.csv"
    p.write_text(G1_CSV)
    return ingest.load(spark, str(p)).coalesce(1).cache()
