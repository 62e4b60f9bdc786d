"""Names that the tests share; not in conftest, since another folder has a module of that name too."""

DATA = "/root/testdata/sf0.001"
