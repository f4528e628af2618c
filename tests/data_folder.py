"""The folder of the small test tables."""

DATA = "/root/testdata/sf0.001"
