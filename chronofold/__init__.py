"""Variability analytics for irregular multi-band time series on Spark DataFrames."""

import os

# One BLAS thread a Python worker: tasks already fill the cores.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
