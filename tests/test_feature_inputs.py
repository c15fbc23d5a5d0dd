import os

import pytest

from tidepanel.plans.feature_queries import feature_table_of

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_the_feature_table_reads_no_large_table_again(spark):
    assert not [f for f in feature_table_of(spark, SF).inputFiles() if "tidepanel-state" not in f]
