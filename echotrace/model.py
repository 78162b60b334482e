"""Schemas, settings and fixed values of the reuse analysis."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

CELLS = (
    "source_path string, sheet string, row int, column int, coordinate string, canonical_value string, display_value string, "
    "hidden_sheet boolean, column_header string, header_row int, formula string"
)
LOCATION = "struct<source_path: string, sheet: string, coordinate: string, hidden_sheet: boolean>"
FINDINGS = (
    f"finding_id string, rule_id string, finding_type string, risk string, title string, description string, locations array<{LOCATION}>, "
    "confidence double, details string, review_status string"
)
ISSUES = "source_path string, message string, severity string"

#: Approximate bands from strict to loose, as shares; the label of each; their confidences.
BANDS = ((0.0001, "0.01%", 0.65), (0.001, "0.1%", 0.55), (0.01, "1%", 0.45))
#: What a rule weighs when several explain one pair of series, or compete for attention. Others weigh 50.
STRENGTH = {
    "excel.region.exact": 100,
    "excel.row.exact": 98,
    "excel.series.exact": 96,
    "excel.series.fragment_exact": 94,
    "excel.series.shuffled": 90,
    "excel.series.near_duplicate": 88,
    "excel.series.target_sum": 86,
    "excel.series.target_product": 86,
    "excel.series.target_difference": 84,
    "excel.series.target_quotient": 84,
    "excel.series.scale": 82,
    "excel.series.offset": 82,
    "excel.series.linear": 80,
    "excel.digit_fragment": 76,
    "excel.series.statistics": 30,
    "excel.value.exact": 20,
    "excel.value.approximate": 10,
    "excel.cell.target_operation": 8,
}
#: Places in the attention queue in all, of a workbook, a sheet, a rule, and of digit fragments.
QUEUE, QUEUE_WORKBOOK, QUEUE_SHEET, QUEUE_RULE, QUEUE_DIGITS = 50, 10, 3, 16, 12
#: Findings of a rule, and of a scope within it; series of one length that are all compared; series of a pattern's bucket.
RULE_LIMIT, SCOPE_LIMIT, ALL_PAIRS, BUCKET_LIMIT = 300, 6, 250, 64


@dataclass(frozen=True)
class Settings:
    minimum_digit_run: int = 4
    custom_relative_tolerance_percent: float = 0.0
    absolute_tolerance: float = 1e-12
    operation_targets: tuple[float, ...] = field(default=(0.0, 1.0, 10.0, 100.0, 1000.0))
    medium_run_length: int = 3
    high_run_length: int = 4
    image_analysis_mode: str = "auto"
    western_single_band_enabled: bool = False
    scan_mode: str = "all"

    def __post_init__(self) -> None:
        if not 3 <= self.minimum_digit_run <= 12:
            raise ValueError("minimum_digit_run must be from 3 to 12")
        if not 0 <= self.custom_relative_tolerance_percent <= 100:
            raise ValueError("custom_relative_tolerance_percent must be from 0 to 100")
        if not (math.isfinite(self.absolute_tolerance) and self.absolute_tolerance > 0):
            raise ValueError("absolute_tolerance must be positive")
        if not 1 <= len(self.operation_targets) <= 20 or not all(map(math.isfinite, self.operation_targets)):
            raise ValueError("1 to 20 finite operation_targets")
        if self.medium_run_length < 2 or self.high_run_length <= self.medium_run_length:
            raise ValueError("run lengths must be 2 or more and rise")
        if self.image_analysis_mode not in ("auto", "generic", "western_blot", "dot_blot", "fluorescence", "pathology"):
            raise ValueError(f"unknown image_analysis_mode {self.image_analysis_mode}")
        if self.scan_mode not in ("all", "image", "data"):
            raise ValueError(f"unknown scan_mode {self.scan_mode}")
        object.__setattr__(self, "operation_targets", tuple(sorted(set(map(float, self.operation_targets)))))

    @property
    def custom_relative(self) -> float:
        return self.custom_relative_tolerance_percent / 100

    @property
    def relative_tolerance(self) -> float:
        return max(1e-9, self.custom_relative)
