"""Business policy as plain data.

Every value here is a fixed policy constant.  The operators turn them into literals while the plan is
built, so Catalyst can fold them and no row ever looks up a configuration file.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: vendor names -------------------------------------------------------------------
CORPORATE_WORDS = (
    "llc", "ltd", "inc", "corp", "corporation", "pvt", "private", "limited", "co", "company",
    "group", "services", "solutions", "technologies",
)

# --- fixed values: import placeholders for "no purchase order" ------------------------------------
PO_PLACEHOLDERS = (
    "none", "n/a", "na", "null", "nil", "-", "nan", "n.a.", "n.a", "missing", "not applicable",
)
ROW_PO_PLACEHOLDERS = (
    "none", "n/a", "na", "null", "nil", "-", "nan", "missing", "not applicable", "unknown",
)
HEADER_PO_PLACEHOLDERS = ("n/a", "none", "null", "-")

# --- fixed values: locale -------------------------------------------------------------------------
CURRENCY_SYMBOLS = (
    ("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("₹", "INR"), ("¥", "JPY"), ("C$", "CAD"), ("A$", "AUD"),
)
UNIT_ALIASES = {
    "ea": "each", "each": "each", "pc": "each", "pcs": "each", "unit": "each",
    "hr": "hour", "hrs": "hour", "hour": "hour", "kg": "kg", "lb": "lb", "lbs": "lb",
}
DATE_PATTERNS = (
    "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy",
)
TERMS_PATTERNS = (
    r"net\s*(\d+)", r"(\d+)\s*days?\s*after", r"payment\s*(\d+)\s*days", r"due\s*in\s*(\d+)\s*days",
)
CHARGE_LABELS = (
    ("shipping", ("shipping", "shipping & handling", "shipping and handling", "freight", "delivery",
                  "carriage", "transport")),
    ("handling", ("handling", "processing fee")),
    ("maintenance", ("maintenance", "service fee", "maintenance fee")),
    ("surcharge", ("surcharge", "fuel surcharge", "misc", "miscellaneous")),
    ("discount", ("discount", "rebate", "credit", "promotion")),
)

# --- fixed values: line descriptions --------------------------------------------------------------
NOISE_WORDS = ("THE", "A", "AN", "AND", "OR", "FOR", "OF", "IN", "TO", "WITH")

# --- fixed values: extraction fields --------------------------------------------------------------
FIELD_STATUSES = ("extracted", "inferred", "not_found", "uncertain")
HEADER_FIELDS = (
    "vendor_name", "invoice_number", "invoice_date", "due_date", "due_date_terms", "po_reference",
    "currency", "subtotal", "tax_amount", "total_amount",
)
PAGE_CLASSES = ("line_items", "terms_and_conditions", "signature_block", "attachment", "other")
SKIPPED_PAGE_CLASSES = ("terms_and_conditions", "signature_block")


@dataclass(frozen=True)
class ExtractionPolicy:
    """Stage 1: routing of an extracted invoice."""

    arithmetic_tolerance_cents: int = 1
    residual_review_cents: int = 5000
    approval_fields: tuple = ("total_amount", "vendor_name", "currency")
    matchable_signals: tuple = ("vendor_name", "total_amount", "po_reference", "line_items", "typed_references")
    allow_partial_evidence: bool = True
    thresholds: tuple = (
        ("total_amount", 0.95), ("tax_amount", 0.95), ("currency", 0.85), ("invoice_number", 0.90),
        ("vendor_name", 0.85), ("invoice_date", 0.90), ("po_reference", 0.70), ("due_date", 0.70),
        ("line_items", 0.75),
    )
    confidence_boost: float = 0.05
    boosted_fields: tuple = ("invoice_date", "total_amount")
    blocking_verification_fields: tuple = ("total_amount", "vendor_name", "currency")
    quiet_verification_fields: tuple = (
        "due_date", "po_reference", "subtotal", "tax_amount", "line_items", "invoice_number", "invoice_date",
    )
    inferred_currency_confidence: float = 0.85

    def threshold(self, field: str) -> float:
        return dict(self.thresholds)[field]


RETRIEVAL_WEIGHTS = {
    "exact": 1.0, "normalized": 0.85, "reference": 0.75, "vendor_search": 0.55, "vendor_amount": 0.45,
    "unique_vendor_amount": 0.7, "vendor_name": 0.5, "fuzzy": 0.25, "import_derived": 0.55,
    "source_record": 0.55, "source_record_invoice": 0.65, "source_record_po_hint": 0.55,
}
DEFAULT_RETRIEVAL_WEIGHT = 0.1


@dataclass(frozen=True)
class MatchPolicy:
    """Stage 2: candidate retrieval, scoring and the match gates."""

    max_po: float = 40.0
    max_vendor: float = 20.0
    max_line: float = 20.0
    max_amount: float = 10.0
    max_date: float = 5.0
    partial_usage_full_score: bool = True
    over_remaining_tolerance: float = 0.05
    max_candidates: int = 20
    vendor_amount_tolerance: float = 0.15
    vendor_amount_top: int = 10
    fuzzy_min_ratio: float = 0.6
    fuzzy_top: int = 5
    allow_broadcast: bool = False
    vendor_fuzzy_min: float = 0.70
    ambiguous_gap: float = 5.0
    auto_select_gap: float = 15.0
    exact_threshold: float = 95.0
    high_confidence_threshold: float = 85.0
    minimum_threshold: float = 70.0
    unique_tolerance: float = 0.02
    gate_min_vendor: float = 15.0
    gate_min_amount: float = 8.0
    gate_min_line: float = 14.0
    gate_min_coverage: float = 0.85
    gate_min_gap: float = 10.0
    single_po_tolerance: float = 0.15
    line_min_score: float = 0.25
    suggestions: int = 10
    multi_po_top: int = 5
    # "blend" averages token overlap and sequence ratio; "tokens" uses token overlap alone and switches
    # the two sequence-ratio retrieval layers off, so that plain SQL can recompute the whole match.
    similarity: str = "blend"


@dataclass(frozen=True)
class CheckPolicy:
    """Stage 3: validation tolerances."""

    price_tolerance: float = 0.02
    quantity_tolerance: float = 0.05
    tax_tolerance: float = 0.12
    budget_tolerance: float = 0.05
    tax_mode: str = "expected_rate"
    default_tax_rate: float = 0.08
    vendor_tax_rates: tuple = (("rogers, smith and hobbs", 0.193),)
    approval_thresholds_cents: tuple = (1_000_000, 2_500_000, 5_000_000)
    shaving_band: float = 0.03
    new_vendor_amount_cents: int = 2_000_000
    near_duplicate_days: int = 3
    grn_required_types: tuple = ("standard",)
    two_way_types: tuple = ("blanket",)
    blocking_decisions: tuple = ("APPROVE", "AUTO_APPROVED", "APPROVAL_REQUIRED")
    ignored_decisions: tuple = ("REJECT", "TERMINAL_REJECT")
    ignored_stage3: tuple = ("BLOCKED",)
    block_if_allocated: bool = True


BLOCK_REASONS = ("DUPLICATE_CONFIRMED", "VENDOR_BLACKLISTED")
CHECK_ORDER = (
    "amount_variance", "tax_validation", "duplicate_detection", "vendor_validation", "receipt_match",
    "budget_tolerance", "fraud_signals", "extraction_completeness",
)
LIMITED_CHECKS = ("duplicate_detection", "vendor_validation", "fraud_signals")


@dataclass(frozen=True)
class DecisionPolicy:
    """Stage 4: materiality, authority and routing."""

    auto_limit_cents: int = 500_000
    manager_limit_cents: int = 5_000_000
    director_limit_cents: int = 50_000_000
    new_vendor_threshold_cents: int = 1_000_000
    freshness_hours: int = 24
    policy_id: str = "AP-DEFAULT"
    policy_version: str = "AP-2026.08.1"


APPROVAL_GROUPS = {"LOW": "finance-manager-group", "MEDIUM": "finance-manager-group",
                   "HIGH": "finance-director-group", "CRITICAL": "cfo-group"}
APPROVAL_LIMITS = {"LOW": 5000.0, "MEDIUM": 50000.0, "HIGH": 500000.0, "CRITICAL": float("inf")}

# substate -> (target queue, priority, SLA hours, resume condition)
ROUTING = {
    "AUTO_APPROVED": (None, "NORMAL", 0, None),
    "APPROVAL_REQUIRED": (None, "NORMAL", 24, None),
    "STANDARD_REVIEW": ("ap-exception-queue", "NORMAL", 48, None),
    "HIGH_PRIORITY_REVIEW": ("senior-finance-queue", "HIGH", 8, None),
    "FRAUD_REVIEW": ("security-fraud-queue", "URGENT", 4, None),
    "VENDOR_SECURITY_REVIEW": ("vendor-security-queue", "HIGH", 4, None),
    "POLICY_EXCEPTION_REVIEW": ("policy-admin-queue", "HIGH", 8, None),
    "TERMINAL_REJECT": (None, "NORMAL", 0, None),
    "WAITING_FOR_GRN": ("receiving-queue", "NORMAL", 72, "GRN_RECEIVED"),
    "WAITING_FOR_REQUIRED_DATA": ("data-resolution-queue", "NORMAL", 48, "DATA_AVAILABLE"),
    "REVALIDATION_REQUIRED": ("revalidation-queue", "HIGH", 4, "REVALIDATION_COMPLETE"),
    "POLICY_CONFIGURATION_ERROR": ("policy-admin-queue", "URGENT", 4, "POLICY_CONFIGURED"),
}
DEFAULT_ROUTE = ("ap-exception-queue", "NORMAL", 48, None)

# substate -> (control that must be proven, description)
CONTROL_REQUIREMENTS = {
    "APPROVAL_REQUIRED": ("APPROVAL", "Human approval required"),
    "VENDOR_SECURITY_REVIEW": ("BANK_VERIFICATION", "Vendor bank detail verification"),
    "FRAUD_REVIEW": ("FRAUD_INVESTIGATION", "Fraud investigation review"),
    "HIGH_PRIORITY_REVIEW": ("SENIOR_REVIEW", "Senior finance review"),
    "STANDARD_REVIEW": ("AP_REVIEW", "AP exception review"),
    "POLICY_EXCEPTION_REVIEW": ("POLICY_REVIEW", "Policy administrator review"),
}

MATCH_STATES = (
    "matched", "high_confidence_match", "ambiguous_match", "partial_match", "non_po_workflow",
    "waiting_for_po", "suggested_po_match", "waiting_for_grn", "closed_po_review", "unmatched",
    "no_matching_evidence", "multiple_candidates", "po_suggestions_rejected",
)
FULL_VALIDATION_STATES = (
    "matched", "high_confidence_match", "partial_match", "ambiguous_match", "waiting_for_grn", "closed_po_review",
)
NO_VALIDATION_STATES = ("waiting_for_po", "suggested_po_match", "unmatched", "multiple_candidates")
TRUSTED_PROVENANCE = ("evidence", "authoritative_po", "human_confirmed")
PO_RESOLVED_STATES = ("matched", "high_confidence_match", "partial_match")

EXTRACTION = ExtractionPolicy()
MATCH = MatchPolicy()
MATCH_TOKENS = MatchPolicy(similarity="tokens")
CHECKS = CheckPolicy()
DECISION = DecisionPolicy()
