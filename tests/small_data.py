"""The small shared tables that the tests read."""

SF_SMALL = "/root/testdata/sf0.001"
