"""Business settings of a reconciliation run."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal


@dataclass(frozen=True)
class Config:
    # Thresholds, weights and status names that decide results.
    tolerance: Decimal = Decimal("0.05")
    zero_rate_tolerance: Decimal = Decimal("0.01")
    similarity_threshold: float = 85.0
    candidate_limit: int = 5
    suggestion_limit: int = 3
    amount_weight: int = 60
    date_weight: int = 30
    similarity_weight: float = 0.1
    outlier_factor: int = 10
    outlier_min_samples: int = 3
    tax_share_limit: Decimal = Decimal("0.15")
    scan_chars_per_page: int = 40
    ocr_min_confidence: int = 30
    ocr_char_width: int = 9
    expected_statuses: tuple[str, ...] = (
        "Order Complete", "Delivered", "Partial Delivered", "Pending Payment")

    # The buyer's own identifiers. A buyer sets these to its name and numbering scheme.
    po_prefix: str = "PO"
    prior_period: str = "2025"
    buyer_names: tuple[str, ...] = field(default=("THE BUYER COMPANY",))

    @property
    def po_pattern(self) -> str:
        return rf"(?<![A-Za-z0-9])({self.po_prefix}\d{{9,}})(?!\d)"

    @property
    def po_full_pattern(self) -> str:
        return rf"{self.po_prefix}\d{{9,}}"

    @property
    def prior_po_pattern(self) -> str:
        return rf"(?i)^{self.po_prefix}{self.prior_period}"
