"""Monte Carlo analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from quincunx.operators.fidelity import histogram_distance, quantile_error, result_digest, result_events  # noqa: E402
from quincunx.operators.histogram import histogram, histogram_rows  # noqa: E402
from quincunx.operators.moments import (  # noqa: E402
    block_correlation,
    block_moments,
    column_moments,
    fold_moments,
    report_moments,
)
from quincunx.operators.quantiles import exact_quantiles, weighted_quantiles  # noqa: E402
from quincunx.operators.sketch import block_sketches, merge_sketches, rank_error  # noqa: E402
from quincunx.plans.program import (  # noqa: E402
    Diagnostic,
    Discrete,
    Normal,
    Program,
    ProgramError,
    Uniform,
    read_formula,
    read_program,
)
from quincunx.plans.report import NoFiniteResult, branch_values, report  # noqa: E402
from quincunx.sources.draws import with_draws, with_uniforms  # noqa: E402
from quincunx.sources.reports import flat_report, write_report  # noqa: E402
from quincunx.streaming.progress import progress_events, read_progress, start_progress, work_folder  # noqa: E402

__all__ = [
    "Diagnostic", "Discrete", "NoFiniteResult", "Normal", "Program", "ProgramError", "Uniform", "block_correlation",
    "block_moments", "block_sketches", "branch_values", "column_moments", "exact_quantiles", "flat_report", "fold_moments",
    "histogram", "histogram_distance", "histogram_rows", "merge_sketches", "progress_events", "quantile_error", "rank_error",
    "read_formula", "read_program", "read_progress", "report", "report_moments", "result_digest", "result_events",
    "start_progress", "weighted_quantiles", "with_draws", "with_uniforms", "work_folder", "write_report",
]
